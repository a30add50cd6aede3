"""Column expressions for label scores, vectors and percentiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import LABELS
from .text import let


def zero() -> Column:
    return F.lit(0.0)


def normalized(scores: Sequence[Column]) -> list[Column]:
    """Scores of A to D, not below 0 and with sum 1; uniform if all are 0."""
    clamped = [F.greatest(F.coalesce(x, zero()), zero()) for x in scores]
    total = reduce(add, clamped)
    return [F.when(total == 0, F.lit(1.0 / len(LABELS))).otherwise(x / total) for x in clamped]


def entropy(p: Sequence[Column]) -> Column:
    return -reduce(add, [F.when(x > 0, x * F.log(x)).otherwise(zero()) for x in p]) + zero()


def js_divergence(p: Sequence[Column], q: Sequence[Column]) -> Column:
    def half(a: Column, b: Column) -> Column:
        return F.when((a > 0) & (a + b > 0), a * F.log(a / (0.5 * (a + b)))).otherwise(zero())

    return 0.5 * reduce(add, [half(a, b) for a, b in zip(p, q, strict=True)]) + 0.5 * reduce(add, [half(b, a) for a, b in zip(p, q, strict=True)])


def js_divergence_maps(p: Column, q: Column) -> Column:
    """The same for maps with any labels."""
    keys = F.array_union(F.map_keys(p), F.map_keys(q))
    get = lambda m, k: F.coalesce(F.try_element_at(m, k), zero())

    def term(k: Column) -> Column:
        a, b = get(p, k), get(q, k)
        part = lambda x, y: F.when((x > 0) & (x + y > 0), x * F.log(x / (0.5 * (x + y)))).otherwise(zero())
        return 0.5 * part(a, b) + 0.5 * part(b, a)

    return F.aggregate(F.transform(keys, term), zero(), lambda s, x: s + x)


def top_label(p: Sequence[Column]) -> Column:
    """The label of the largest score, the first of equals."""
    out = F.lit(LABELS[-1])
    for i in reversed(range(len(p) - 1)):
        out = F.when(p[i] >= F.greatest(*p[i + 1 :], p[i]), LABELS[i]).otherwise(out)
    return out


def top_label_map(p: Column) -> Column:
    """The same for a map in its own order; null for an empty one."""
    best = F.array_max(F.map_values(p))
    return F.try_element_at(F.map_keys(p), F.array_position(F.map_values(p), best).cast("int"))


def margin(p: Sequence[Column]) -> Column:
    ordered = F.sort_array(F.array(*p), asc=False)
    return ordered[0] - ordered[1]


def gold_probability(p: Sequence[Column], gold: Column) -> Column:
    out = F.lit(None).cast("double")
    for x, label in zip(p, LABELS, strict=True):
        out = F.when(gold == label, x).otherwise(out)
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, zero())), zero(), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, zero(), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Over what both have, by the norms of all of each; 0 if either is 0."""
    return F.when((norm(a) != 0) & (norm(b) != 0), dot(a, b) / (norm(a) * norm(b))).otherwise(zero())


def norm_preserving_add(h: Column, v: Column, alpha: Column) -> Column:
    """h + alpha v over what both have, brought to the length of h."""
    n = F.least(F.size(h), F.size(v))
    u = F.zip_with(F.slice(h, 1, n), F.slice(v, 1, n), lambda x, y: x + alpha * y)
    scaled = lambda v, size: F.when(size == 0, v).otherwise(let(norm(h) / size, lambda s: F.transform(v, lambda x: x * s)))
    return let(u, lambda v: let(norm(v), lambda size: scaled(v, size)))


def visual_reliance(a: Column, b: Column) -> Column:
    return F.greatest(a - b, zero())




def gap(a: Column, b: Column) -> Column:
    """By how much one language's accuracy exceeds another's."""
    return a - b


def probability_drop(matched: Column, other: Column) -> Column:
    """How much of the gold label's probability is lost with another screen."""
    return matched - other


def condition_name(question_language: Column, gui_language: Column) -> Column:
    """Which condition an oracle's screen makes."""
    return F.when(question_language.eqNullSafe(gui_language), "canonical_matched").otherwise("oracle_aligned")


def matrix_key(question_language: Column, gui_language: Column) -> Column:
    """The name of a cell of a matrix of languages."""
    return F.concat(question_language, F.lit("->"), gui_language)
