"""URL filters: pattern rules indexed by their rarest literal token.

A rule becomes a regular expression and the literal tokens (runs of ASCII letters and digits) that every URL it fits holds as whole tokens.
One pass over all URLs counts how many hold each of those tokens; a rule is filed under its rarest one. A second pass looks each URL's
tokens up and runs the expressions of the rules found there, and of the few rules without a whole token; no other
expression is run. What is broadcast are rules, which don't grow with the pages: ``RULES_AT_A_TIME`` of them in a pass, the passes one after the other within a stage.

A pattern starts anywhere, with ``|`` at the beginning of the host, or with ``||`` at the beginning of a label of it; it ends anywhere, or with ``|`` at the end. ``*`` stands for any characters
(up to the first slash of a pattern with ``||``: of the host), ``^`` for the end or a character that is no letter, digit or one of ``_ . % -``. Patterns are compared with the host, in lower case, and what follows it.

Of the rules that fit, those for hosts and paths go before the patterns, then the longest wins, then one that blocks. Where none fits, the URL is allowed.

A host ends before the first slash, question mark or hash after ``://``; the path before a question mark or hash. Null URLs and those without ``://`` have an empty host and path, and no rule fits
them. URLs of any length are looked at whole. Repeated rows and null ids are judged as they come; other columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile("[0-9A-Za-z]+")
#: Rules that a pass holds in a worker's memory.
RULES_AT_A_TIME = 100_000
#: Words that give a host away if they stand between dots and hyphens, and pages that hold no text of their own.
WORDS = ("adult", "ads", "adserver", "bet", "bets", "casino", "escort", "gambling", "loans", "pharma", "pills", "poker", "porn", "sex", "spam", "viagra", "xxx")
PAGES = ("/cgi-bin/", "/wp-login.php^", "?phpsessid=")
HOSTS = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


@dataclass(frozen=True)
class Rule:
    """``regex`` is searched in a URL's host and what follows it; ``tokens`` are in every URL that it fits."""

    name: str
    verdict: str
    regex: str
    tokens: frozenset[str] = field(default_factory=frozenset)
    of_host: bool = False

    @property
    def order(self) -> tuple:
        return self.of_host, len(self.name), self.verdict == "block", self.name


def whole_tokens(literals: list[str | None], open_start: bool, open_end: bool) -> frozenset[str]:
    """Tokens of a pattern's literal characters that nothing can prolong; None stands for any characters."""
    text = "".join("\0" if c is None else c for c in literals)
    text = ("\0" if open_start else "/") + text + ("\0" if open_end else "/")
    return frozenset(m[0].lower() for m in TOKEN.finditer(text) if "\0" not in (text[m.start() - 1], text[m.end()]))


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """For a host and all its subdomains where the path starts with ``path``."""
    host = host.translate(str.maketrans(ascii_uppercase, ascii_lowercase))
    return Rule(host + path, verdict, rf"^(?:[^/?#]*\.)?{re.escape(host)}(?=[/?#]|\Z){re.escape(path)}", whole_tokens(list(host + path), False, not path or True), True)


def pattern_rule(pattern: str, verdict: str) -> Rule:
    of_host, at_start, at_end = pattern.startswith("||"), pattern.startswith("|"), pattern.endswith("|") and len(pattern) > 2
    body = pattern.lstrip("|")[: -1 if at_end else None]
    out, within, literals = "^" if at_start else "", of_host, []
    if of_host and not body.startswith("*"):
        out += r"(?:[^/?#]*\.)?"
    for c in body:
        if c == "*":
            out += "[^/?#]*" if within else r"[\s\S]*"
        else:
            out += r"(?:[^0-9A-Za-z_.%-]|\Z)" if c == "^" else re.escape(c)
            within = within and c not in "/?#^"
        literals.append({"*": None, "^": "/"}.get(c, c))
    return Rule(pattern, verdict, out + (r"\Z" if at_end else ""), whole_tokens(literals, not at_start, not at_end))


def default_rules() -> list[Rule]:
    """The rules of production: hosts and paths, words of hosts, pages without text."""
    of_words = [x for w in WORDS for x in (f"||{w}-", f"||{w}.", f"||*-{w}-", f"||*-{w}.")]
    return [host_rule(*x) for x in HOSTS] + [pattern_rule(x, "block") for x in (*of_words, *PAGES)]


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and the host with all that follows it."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    named = F.regexp_extract(after, "^[^/?#]*", 0)
    host = F.translate(named, ascii_uppercase, ascii_lowercase)
    rest = F.substr(after, F.length(named) + 1)
    return host, F.regexp_extract(rest, "^[^?#]*", 0), F.concat(host, rest)


def token_counts(subjects: DataFrame, tokens: set[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens is."""
    if not tokens:
        return {}
    asked = subjects.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    held = subjects.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("subject"), F.lit("[0-9a-z]+"), 0))).alias("token"))
    return {r.token: r.n for r in held.join(F.broadcast(asked), "token").groupBy("token").agg(F.count("*").alias("n")).collect()}


class Index:
    """Rules by their rarest token; what has no whole token is tried on every URL."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.rules: dict[str, list[Rule]] = {}
        self.always: list[Rule] = []
        for rule in rules:
            if rule.tokens:
                self.rules.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(rule)
            else:
                self.always.append(rule)
        self.compiled: dict[str, re.Pattern] = {}

    def candidates(self, subject: str) -> list[Rule]:
        return self.always + [r for t in {x.lower() for x in TOKEN.findall(subject)} for r in self.rules.get(t, ())]

    def best(self, subject: str) -> Rule | None:
        """Of the rules that fit the one that decides."""
        found = None
        for rule in self.candidates(subject):
            if found is not None and rule.order < found.order:
                continue
            if rule.regex not in self.compiled:
                self.compiled[rule.regex] = re.compile(rule.regex)
            if self.compiled[rule.regex].search(subject):
                found = rule
        return found


def judged(pages: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url: str = "url", at_a_time: int = RULES_AT_A_TIME) -> DataFrame:
    """id, host, path, rule (of hosts), pattern (of the others) and verdict of every row."""
    rules = sorted(set(default_rules() if rules is None else rules), key=lambda r: r.order)
    host, path, subject = parts(F.col(url))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), subject.alias("subject"))
    counts = token_counts(rows.select("subject"), {t for r in rules for t in r.tokens})
    spark, schema = pages.sparkSession, f"id {rows.schema['id'].dataType.simpleString()}, host string, path string, subject string, best int"
    names = spark.sparkContext.broadcast([(r.name, r.verdict, r.of_host) for r in rules])
    rows = rows.withColumn("best", F.lit(-1))
    for first in range(0, len(rules), at_a_time):
        rows = rows.mapInArrow(_decider(spark.sparkContext.broadcast((first, rules[first : first + at_a_time], counts))), schema)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [*names.value, (None, "allow", False)]  # the last is what no rule fits
        for batch in batches:
            best = [known[i] for i in batch.column("best").to_pylist()]
            columns = {"id": batch.column("id"), "host": batch.column("host"), "path": batch.column("path")}
            for name, values in (("rule", [n if h else None for n, _, h in best]), ("pattern", [None if h else n for n, _, h in best]), ("verdict", [v for _, v, _ in best])):
                columns[name] = pa.array(values, pa.string())
            yield pa.record_batch(columns)

    return rows.mapInArrow(told, schema.replace("subject string, best int", "rule string, pattern string, verdict string")).withColumnRenamed("id", id_col)


def _decider(shared):
    """A pass with some of the rules, which are numbered in their order: the largest number that fits decides."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, rules, counts = shared.value
        number = {r: first + i for i, r in enumerate(rules)}
        index = Index(rules, counts)
        for batch in batches:
            found = [index.best(x) for x in batch.column("subject").to_pylist()]
            best = [old if r is None else max(old, number[r]) for r, old in zip(found, batch.column("best").to_pylist(), strict=True)]
            yield batch.set_column(batch.schema.get_field_index("best"), "best", pa.array(best, pa.int32()))

    return decide


def verdicts(pages: DataFrame) -> DataFrame:
    return judged(pages).select(F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule", "verdict")


_ALL = "'" + ascii_uppercase + "', '" + ascii_lowercase + "'"
#: The same rows, by looking at every rule for every URL.
SQL = f"""
with a as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as named from a),
p as (select page_id, translate(named, {_ALL}) as host, substr(rest, length(named) + 1) as rest from h),
s as (select page_id, host, regexp_extract(rest, '^[^?#]*') as path, rest from p),
r as (select * from (values {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in HOSTS)}) t(rule_host, rule_path, verdict)),
f as (select s.*, coalesce((select max(length(rule_host || rule_path) * 2 + (verdict = 'block')::int) from r where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)), -1) as best,
      regexp_matches(host, '(^|[-.])({"|".join(WORDS)})[-.]') or contains(rest, '/cgi-bin/') or regexp_matches(rest, '/wp-login\\.php([^0-9A-Za-z_.%-]|$)') or contains(rest, '?phpsessid=') as bad from s)
select f.page_id, host, path, r.rule_host || r.rule_path as rule, coalesce(r.verdict, case when bad then 'block' else 'allow' end) as verdict
from f left join r on length(rule_host || rule_path) * 2 + (r.verdict = 'block')::int = best and (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
"""
