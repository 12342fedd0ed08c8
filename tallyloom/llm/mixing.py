"""Mixing sources to target weights by iterative proportional fitting (raking).

Token totals of the cells (source, language, topic) are raked to target marginals, and each
document is then drawn with its cell's calibrated probability, so that the drawn tokens are a
given share of all in expectation. Only DataFrame expressions: a cell's weight is the product
of a factor for each axis, and a sweep sums the cell table, whose size is the number of distinct
cells, once by source and once by pairs of the other two.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.llm.common import Written, fresh

#: Topic rules in order of precedence: name, pattern over the whole text. Fixed values.
TOPICS = (("licence", r"(?i)\blicensed? under\b|\bcopyright\b"), ("table", r"\|"), ("numeric", r"\d"))
OTHER_TOPIC = "prose"
KEYS = ("source", "lang", "topic")
#: Sweeps between two looks at how far the factors still move.
SWEEPS_A_JOB = 2
#: Cells in a partition of the cell table, about.
CELLS_A_TASK = 100_000
#: Parts of each cell's documents where the cell table is too large to be broadcast.
SALTS = 64


@dataclass(frozen=True)
class Mixture:
    """Target shares. A marginal without given shares takes (tokens of category)^power, made to sum to 1.

    given: {"source": {"src1": 0.2, ...}, ...}; categories that it doesn't name get the power rule
    for what it leaves. budget: expected share of all tokens that is drawn. Raking ends when no factor
    moves by `settled` of itself in a sweep, or with a warning after `sweeps`. max_broadcast_cells: the cell table
    is broadcast up to that many rows (some 100 bytes each), and joined by a salted shuffle beyond it.
    """

    power: float = 0.9
    budget: float = 0.8
    given: dict = field(default_factory=dict)
    sweeps: int = 40
    settled: float = 1e-10
    seed: int = 17
    max_broadcast_cells: int = 50_000


def topic_of(text: Column) -> Column:
    out = None
    for name, pattern in TOPICS:
        out = (F if out is None else out).when(text.rlike(pattern), name)
    return out.otherwise(OTHER_TOPIC)


def token_count(text: Column) -> Column:
    """Words between white space; cheap, and in proportion to tokens."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("bigint")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from SHA-256, the same on any engine and after any retry."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(hexed, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def described(docs: DataFrame, *, topic: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens; a null key counts as the empty one, a null text has no tokens."""
    text = F.coalesce(F.col("text"), F.lit(""))
    of = topic_of(text) if topic is None else F.coalesce(topic, F.lit(""))
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), of.alias("topic"), token_count(text).alias("n_tokens"))


def _given(mix: Mixture) -> Column:
    """The given share of an axis's category, else null."""
    out = F.lit(None).cast("double")
    for key in KEYS:
        shares = [F.lit(x) for kv in mix.given.get(key, {}).items() for x in (str(kv[0]), float(kv[1]))]
        if shares:
            out = F.when(F.col("axis") == key, F.element_at(F.create_map(*shares), F.col("category"))).otherwise(out)
    return out


def _shares(cells: DataFrame, mix: Mixture) -> DataFrame:
    """axis, category, share (its target), factor 1.0: a row for each category that has tokens."""
    each = F.explode(F.array(*[F.struct(F.lit(key).alias("axis"), F.col(key).alias("category")) for key in KEYS]))
    own = cells.select("tokens", each.alias("_k")).groupBy("_k.axis", "_k.category").agg(F.pow(F.sum("tokens").cast("double"), F.lit(mix.power)).alias("_w"))
    own = Written(own.withColumn("_given", _given(mix)), "shares").df
    share = F.lit(None).cast("double")
    for axis, rest, told in own.groupBy("axis").agg(F.sum(F.when(F.col("_given").isNull(), F.col("_w"))), F.coalesce(F.sum("_given"), F.lit(0.0))).collect():  # three rows
        left, norm = max(1.0 - told, 0.0), told if rest is None else max(1.0, told)
        raw = F.coalesce(F.col("_given"), F.col("_w") / F.lit(rest) * F.lit(left))
        share = F.when(F.col("axis") == axis, F.try_divide(raw, F.lit(norm))).otherwise(share)
    return own.select("axis", "category", F.coalesce(share, F.lit(0.0)).alias("share"), F.lit(1.0).alias("factor"))


def _sweep(cells: DataFrame, pairs: DataFrame, total: float) -> DataFrame:
    """pairs (lang, topic, their shares and factors) after one sweep: source, then language, then topic.

    A source's cells, one for each pair at most, are summed by a window; the sums of the pairs over all sources are
    aggregated before they are shuffled, and the other two steps need no more than the pairs.
    """
    ratio = lambda share, met: F.coalesce(F.try_divide(share * total, met), F.lit(0.0))  # noqa: E731  a category of share 0 has factor 0
    over = lambda col, key: F.sum(col).over(Window.partitionBy(key))
    at = cells.join(pairs, ["lang", "topic"]).withColumn("_sum", over(F.col("tokens") * F.col("_lang") * F.col("_topic"), "source"))
    kept = [F.first(c).alias(c) for c in ("_share_lang", "_share_topic", "_lang", "_topic")]
    met = at.withColumn("_w", F.col("tokens") * ratio(F.col("_share_source"), F.col("_sum"))).groupBy("lang", "topic").agg(F.sum("_w").alias("_w"), *kept)
    for key, other in (("lang", "topic"), ("topic", "lang")):
        met = met.withColumn(f"_new_{key}", ratio(F.col(f"_share_{key}"), over(F.col("_w") * F.col(f"_{other}"), key)))
        met = met.withColumn(f"_moved_{key}", F.coalesce(F.abs(F.try_divide(F.col(f"_new_{key}"), F.col(f"_{key}")) - 1), F.lit(0.0))).withColumn(f"_{key}", F.col(f"_new_{key}"))
    return met.select("lang", "topic", "_share_lang", "_share_topic", "_lang", "_topic", F.greatest("_moved_lang", "_moved_topic").alias("_moved"))


def _weights(cells: DataFrame, shares: DataFrame, total: float, mix: Mixture) -> tuple[DataFrame, float]:
    """cells with weight (raked tokens / tokens), and how far the last sweep moved a factor.

    A cell's raked tokens are its tokens times a factor of its source, one of its language and one of its topic.
    """
    of = lambda key: shares.where(F.col("axis") == key).select(F.col("category").alias(key), F.col("share").alias(f"_share_{key}"))
    held = Written(cells.join(of("source"), "source"), "held").df
    held = held.coalesce(max(1, -(-held.count() // CELLS_A_TASK)))
    pairs = cells.select("lang", "topic").distinct().join(of("lang"), "lang").join(of("topic"), "topic").select("*", F.lit(1.0).alias("_lang"), F.lit(1.0).alias("_topic"))
    pairs = Written(pairs, "pairs").df
    moved = 0.0
    for _ in range(-(-mix.sweeps // SWEEPS_A_JOB)):
        swept = pairs
        for _ in range(SWEEPS_A_JOB):
            swept = _sweep(held, swept, total)
        seen = Observation()
        pairs = Written(swept.observe(seen, F.max("_moved").alias("moved")).drop("_moved"), "pairs").df
        moved = seen.get["moved"] or 0.0
        if moved < mix.settled:
            break
    at = held.join(pairs, ["lang", "topic"]).withColumn("_pair", F.col("_lang") * F.col("_topic"))
    met = F.sum(F.col("tokens") * F.col("_pair")).over(Window.partitionBy("source"))
    weight = F.col("_pair") * F.coalesce(F.try_divide(F.col("_share_source") * total, met), F.lit(0.0))
    return Written(at.select(*KEYS, "tokens", weight.alias("weight")), "weights").df, moved


def _scale(weighted: DataFrame, total: float, mix: Mixture) -> float:
    """The c for which the sum of min(1, c * weight) * tokens is budget * total, by Newton's steps from below.

    The sum is concave and linear between the weights, so the steps rise and end at the answer.
    """
    c = mix.budget
    while True:
        whole = F.col("weight") * F.lit(c) > 1.0
        had, rest = weighted.agg(F.sum(F.when(whole, F.col("tokens"))), F.sum(F.when(~whole, F.col("weight") * F.col("tokens")))).first()
        if not rest:
            return c
        new = (mix.budget * total - (had or 0)) / rest
        if new <= c * (1 + 1e-15):
            return new
        c = new


def raked_cells(cells: DataFrame, mix: Mixture) -> DataFrame:
    """cells (source, lang, topic, tokens; a row each) with probability and weight.

    weight: raked tokens / tokens. probability: min(1, c * weight) with the c for which expected
    tokens are budget * all tokens: a document is drawn at most once, cells that would need more than
    they have are drawn whole, and the others keep their raked proportions. Cells without tokens get
    probability 1. The target of a category of tokens T is T^power / sum of those, or as given. Targets that no
    weights of these cells can meet leave the raking unsettled: the last sweep counts, and a warning says so.
    """
    held = cells.where("tokens > 0")
    total = held.agg(F.sum("tokens")).first()[0]
    empty = cells.where("tokens = 0").select(*KEYS, "tokens", F.lit(1.0).alias("weight"), F.lit(1.0).alias("probability"))
    if not total:
        return empty
    weighted, moved = _weights(held, _shares(held, mix), float(total), mix)
    if moved >= mix.settled:
        warnings.warn(f"raking has not settled: a category's factor still moved by {moved:.2g} in the last of {mix.sweeps} sweeps; see marginals()", stacklevel=2)
    scale = _scale(weighted, float(total), mix)
    return weighted.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * scale)).unionByName(empty)


def marginals(docs: DataFrame, mix: Mixture = Mixture(), *, topic: str | None = None) -> DataFrame:
    """axis, category, supply, target, raked, expected: shares of all tokens in docs, aimed at, after raking, and of the expected draw.

    raked differs from target where targets can't be met together, expected from raked where cells are drawn whole.
    """
    cells = Written(cell_table(docs, topic=topic), "cells").df
    held = Written(raked_cells(cells, mix), "raked").df.where("tokens > 0")
    total, raked, drawn = held.agg(F.sum("tokens"), F.sum(F.col("weight") * F.col("tokens")), F.sum(F.col("probability") * F.col("tokens"))).first()
    each = F.explode(F.array(*[F.struct(F.lit(key).alias("axis"), F.col(key).alias("category")) for key in KEYS]))
    sums = held.select("tokens", "weight", "probability", each.alias("_k")).groupBy("_k.axis", "_k.category").agg(
        (F.sum("tokens") / F.lit(total)).alias("supply"), (F.sum(F.col("weight") * F.col("tokens")) / F.lit(raked)).alias("raked"), (F.sum(F.col("probability") * F.col("tokens")) / F.lit(drawn)).alias("expected")
    )
    return sums.join(_shares(held, mix), ["axis", "category"]).select("axis", "category", "supply", F.col("share").alias("target"), "raked", "expected")


def cell_table(docs: DataFrame, *, topic: str | None = None) -> DataFrame:
    return described(docs, topic=topic).groupBy(*KEYS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))


def mixed(docs: DataFrame, mix: Mixture = Mixture(), *, topic: str | None = None) -> DataFrame:
    """The drawn documents with all their columns, and _mix struct<topic, n_tokens, weight, probability, u>
    (with more underscores where the input has that name).

    A document is drawn if its SHA-256 number is below its cell's probability, so rows that
    repeat a doc_id are drawn together and a retry draws the same rows. topic names a column of docs that holds
    topics; without it TOPICS gives them. Texts of any length are read whole; empty tables give none.
    """
    cells = Written(cell_table(docs, topic=topic), "cells").df
    raked = Written(raked_cells(cells, mix), "raked").df
    side = raked.select(*[F.col(k).alias(f"_c_{k}") for k in KEYS], F.col("weight").alias("_c_weight"), F.col("probability").alias("_c_probability"))
    text = F.coalesce(F.col("text"), F.lit(""))
    t, n, u, info, salt = (fresh(docs.columns, c) for c in ("_mix_topic", "_mix_tokens", "_mix_u", "_mix", "_mix_salt"))
    keyed = docs.withColumn(t, topic_of(text) if topic is None else F.coalesce(topic, F.lit(""))).withColumn(n, token_count(text)).withColumn(u, uniform(F.col("doc_id"), mix.seed))
    on = (F.coalesce(keyed["source"], F.lit("")) == side["_c_source"]) & (F.coalesce(keyed["lang"], F.lit("")) == side["_c_lang"]) & (keyed[t] == side["_c_topic"])
    if raked.count() <= mix.max_broadcast_cells:
        joined = keyed.join(F.broadcast(side), on)
    else:  # each cell's documents go to SALTS tasks, so that a hot cell is no hot task
        keyed = keyed.withColumn(salt, F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)))
        side = side.withColumn("_c_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.join(side, on & (keyed[salt] == side["_c_salt"]))
    joined = joined.where(keyed[u] < side["_c_probability"])
    found = F.struct(keyed[t].alias("topic"), keyed[n].alias("n_tokens"), side["_c_weight"].alias("weight"), side["_c_probability"].alias("probability"), keyed[u].alias("u"))
    return joined.select(*[keyed[c] for c in docs.columns], found.alias(info))
