"""Inputs derived from the star-schema tables, which hold no question files or model outputs. One text serves both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators.manifest import build_manifest
from ..sources.shared import written

_LANG = "case {0}%6 when 0 then 'en' when 1 then 'zh' when 2 then 'fr' when 3 then 'ru' when 4 then 'ja' else 'th' end"
_DIM = "case {0}%8 when 0 then 'wf' when 1 then 'wi' when 2 then 'au' when 3 then 'ap' when 4 then 'ael' when 5 then 'rel' when 6 then 'ri' else 'si' end"

QA = """
select p_partkey, concat(case p_partkey%8 when 0 then 'wf' when 1 then 'wi' when 2 then 'au' when 3 then 'ap' when 4 then 'abs_el' when 5 then 'rel_el' when 6 then 'knowledge_rich' else 'knowledge_sparse' end,'_',language,'.jsonl') as qas_file, p_partkey+1 as qas_line, """ + _DIM.format("p_partkey") + """ as dimension, language,
 case when p_partkey%8 in (6,7) then concat('../images/rich/',language,'/ep_',language,'_',cast(p_partkey as string))
      else concat('../images/',cast(p_partkey%6+1 as string),'/',language,'/',replace(p_name,' ','_'),'_',language,'_',cast(p_partkey as string),'.jpg') end as asset,
 p_partkey%8 in (6,7) as is_episode,
 case when p_partkey%97=0 then concat(p_name,'? C: ',p_type,' A: ',p_brand,' B: size D: none')
      when p_partkey%101=0 then concat(p_name,' Plan B: x A: ',p_brand,' B: ',p_type,' C: size D: none')
      when p_partkey%103=0 then concat(p_name,'? A: ',p_brand,' B: ',p_type,' C: size')
      when p_partkey%107=0 then concat(p_name,'? A: ',p_brand,' B: ',p_type,' C: size D: ')
      else concat(p_name,'?  A: ',p_brand,' (°C). B：',p_type,' C: size ',cast(p_size as string),' D: none') end as question,
 case when p_partkey%211=0 then 'the answer is C' when p_partkey%60=0 and language='ja' then 'D'
      when p_partkey%13=0 then concat(substring('ABCD',p_size%4+1,1),'. Tap it') else substring('ABCD',p_size%4+1,1) end as answer
 from {part} cross join (select * from (values ('en',0),('zh',1),('fr',2),('ru',3),('ja',4),('th',5)) t(language, lang_pos)) where not (p_partkey%50=0 and language='th')
"""  # fmt: skip
OUTPUTS = f"""
select event_id, concat('canonical::',cast(event_id as string)) as input_id, {_LANG.format("event_id")} as language, {_DIM.format("user_id")} as dimension,
 case event_id%10 when 0 then 'A' when 1 then 'Answer: B' when 2 then 'C. tap here' when 3 then '(D) x' when 4 then 'the answer is C' when 5 then ' b ' when 6 then 'A good choice' when 7 then '[B]' when 8 then '' else 'Answer：D' end as raw_output,
 case when event_id%97=0 then null else substring('ABCD',cast(user_id%4 as int)+1,1) end as gold_label,
 case when event_type='error' then 'failed' else 'success' end as status from {{events}}
"""
SCORES = "select vec_id, " + _LANG.format("vec_id") + " as question_language, " + _LANG.format("(vec_id+1+label%5)") + " as gui_language, " + ", ".join(f"cast(element_at(embedding,{4 * i + j + 1}) as double) as {s}_{x}" for i, s in enumerate("mxo") for j, x in enumerate("abcd")) + ", substring('ABCD',cast(label%4 as int)+1,1) as gold_label from {embeddings}"
LOG = "select concat('canonical::',cast(o_orderkey as string)) as input_id, case o_orderstatus when 'F' then 'success' when 'P' then 'failed' else 'dry_run' end as status from {orders}"
FRAMES = "select conv_id, turn, concat('../images/sparse/en/ep_',cast(conv_id as string)) as folder, concat(case when turn%2=0 then 'frame_' else 'Frame_' end,cast(turn*7 as string),case when turn%3=0 then '.JPG' when turn%3=1 then '.png' else '.txt' end) as frame from {conversations}"
PREFLIGHT = "select doc_id, lang as language, source as dimension, text as question, cast(n_chars as int) as text_tokens, case when doc_id%10=0 then null else cast(n_chars%17 as int) end as visual_grid_tokens from {documents}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql, **{name: table(spark, sf_dir, name)})


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, QA, "part")


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a few rows of the table give many question rows: they are spread before they are parsed
    return questions(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "p_partkey", "language")


def listing(rows: DataFrame) -> DataFrame:
    """Files that exist: an asset for each question but every 37th part; of an episode its frames."""
    there = rows.filter("p_partkey % 37 <> 0").select(paths.normalize_asset(F.col("asset")).alias("asset"), "is_episode", "p_partkey").distinct()
    frames = F.transform(F.sequence(F.lit(1).cast("long"), 2 + F.col("p_partkey") % 7), lambda i: F.concat(F.lit("/frame_"), i.cast("string"), F.lit(".jpg")))
    return there.select(F.explode(F.when(F.col("is_episode"), F.transform(frames, lambda f: F.concat("asset", f))).otherwise(F.array("asset"))).alias("path"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qa(spark, sf_dir)
    return build_manifest(rows.drop("dimension", "language"), listing(rows))


def stored_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest as validation gets it: a file that was written, which is read more than once."""
    return written(manifest(spark, sf_dir), "manifest")


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, OUTPUTS, "events")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the language of a vector is by its id, a bigint; element_at counts from 1 in both engines' spelling
    return fixture(spark, sf_dir, SCORES, "embeddings")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, LOG, "orders")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, FRAMES, "conversations")


def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, PREFLIGHT, "documents")
