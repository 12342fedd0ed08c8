"""Longest matches of a dictionary table in texts, and rewriting by it.

At every place of a text, from left to right, the longest source that stands there counts, of equal sources the least rule_id; a match is
consumed whole, and nothing is matched inside a placeholder or across one. The dictionary is a table (rule_id, source, and for rewriting
candidates and probability); it becomes one Aho-Corasick automaton, with which tasks read their texts in one pass.

An automaton is broadcast, so its sources are measured first: beyond MOST_BYTES the dictionary is dealt into blocks by hash of the source, each block reads
all texts, and a text's matches of all blocks are brought together by their places.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.rng import Stream
from tallyloom.operators.transform import PLACEHOLDER, Edit, apply_edits
from tallyloom.sources.shared import written

#: Bytes of sources, candidates and ids in one automaton.
MOST_BYTES = 32 << 20
MATCH = "start int, end int, source string, rule_id string"
EDIT = "array<struct<start:int,end:int,source:string,replacement:string,rule_id:string,out_start:int>>"

_automata: dict[str, ahocorasick.Automaton] = {}


class _Dictionary:
    """Rows (rule_id, source, candidates, probability) as broadcast, and their automaton, made once in each Python process."""

    def __init__(self, rows: list[tuple], name: str):
        self.rows, self.name = rows, name

    def automaton(self) -> ahocorasick.Automaton:
        if self.name not in _automata:
            made = ahocorasick.Automaton()
            for row in self.rows:
                made.add_word(row[1], row)
            if self.rows:
                made.make_automaton()
            if len(_automata) >= 4:
                _automata.clear()
            _automata[self.name] = made
        return _automata[self.name]

    def matches(self, text: str) -> Iterator[tuple[int, tuple]]:
        """(place, rule) left to right without overlap."""
        found = self.automaton()
        for start, span in spans(text) if self.rows else ():
            for end, rule in found.iter_long(span):
                yield start + end + 1 - len(rule[1]), rule

    def longest(self, text: str) -> Iterator[tuple[int, tuple]]:
        """(place, rule): the longest rule of every place where any stands, overlapping ones too."""
        found = self.automaton()
        for start, span in spans(text) if self.rows else ():
            best: dict[int, tuple] = {}
            for end, rule in found.iter(span):
                at = end + 1 - len(rule[1])
                if at not in best or len(best[at][1]) < len(rule[1]):
                    best[at] = rule
            yield from ((start + at, best[at]) for at in sorted(best))


def spans(text: str) -> Iterator[tuple[int, str]]:
    """(place, text) of what stands outside placeholders."""
    at = 0
    for span in text.split(PLACEHOLDER):
        if span:
            yield at, span
        at += len(span) + len(PLACEHOLDER)


def _blocks(entries: DataFrame, most_bytes: int) -> list[_Dictionary]:
    """One dictionary of all sources, or several of at most about most_bytes each; of a repeated source the least rule_id stays."""
    extra = [F.col(c) if c in entries.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("candidates", "array<string>"), ("probability", "double"))]
    kept = entries.where(F.length("source") > 0).select("rule_id", "source", *extra).groupBy("source").agg(F.min_by(F.struct("rule_id", "candidates", "probability"), "rule_id").alias("r"))
    kept = kept.select("r.rule_id", "source", "r.candidates", "r.probability")
    size = F.octet_length("source") + F.octet_length("rule_id") + F.coalesce(F.octet_length(F.array_join("candidates", "")), F.lit(0)) + 16
    total = kept.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n, name = -(-max(total, 1) // most_bytes), uuid.uuid4().hex
    part = F.pmod(F.xxhash64("source"), F.lit(n))
    return [_Dictionary([tuple(r) for r in kept.where(part == i).orderBy("source").toLocalIterator()], f"{name}-{i}") for i in range(n)]


def dictionary_matches(rows: DataFrame, entries: DataFrame, key: str, text: str, *, most_bytes: int = MOST_BYTES) -> DataFrame:
    """key, start, end, source, rule_id: a row for each match; places are code points. A null text has none, and repeated rows have their own.

    One text's matches never gather: with several blocks they pass in order of their places.
    """
    blocks = _blocks(entries, most_bytes)
    kind = f"{key} {rows.schema[key].dataType.simpleString()}, {MATCH}"
    slim = rows.select(key, text)
    if len(blocks) == 1:
        return slim.mapInArrow(_reader(rows, blocks[0], key, _Dictionary.matches), kind)
    slim = written(slim.withColumn("_place_of_row", F.monotonically_increasing_id()), "texts")
    found = None
    for block in blocks:
        one = slim.select("_place_of_row", text).mapInArrow(_reader(rows, block, "_place_of_row", _Dictionary.longest), f"_place_of_row long, {MATCH}")
        found = one if found is None else found.unionAll(one)
    # spread over all tasks by row: within one, places go from left to right, the longest first
    ordered = found.repartition("_place_of_row").sortWithinPartitions("_place_of_row", "start", F.desc("end"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, until = None, 0
        for batch in batches:
            keep = []
            for r, start, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if r != row:
                    row, until = r, 0
                keep.append(start >= until)
                until = end if keep[-1] else until
            yield batch.filter(pa.array(keep, pa.bool_()))

    best = ordered.mapInArrow(chosen, ordered.schema)
    return best.join(slim.select("_place_of_row", key), "_place_of_row").select(key, "start", "end", "source", "rule_id")


def _reader(rows: DataFrame, block: _Dictionary, key: str, how):
    shared = rows.sparkSession.sparkContext.broadcast(block)  # MOST_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                for place, rule in how(shared.value, value or ""):
                    at.append(i)
                    found.append((place, place + len(rule[1]), rule[1], rule[0]))
            columns = list(zip(*found)) or [[], [], [], []]
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[key, "start", "end", "source", "rule_id"])

    return run


def rewritten_text(text: str, found: list[tuple[int, str, str, list[str] | None, float | None]], rng: Stream, scale: float) -> tuple[str, list[Edit]]:
    """found: (place, rule_id, source, candidates, probability). A match is consumed whether its draw succeeds or not; a candidate equal to the source changes nothing."""
    edits = []
    for at, rule_id, source, candidates, probability in found:
        if candidates and rng.happens(min(1.0, (1.0 if probability is None else probability) * scale))[0]:
            pick = candidates[rng.below(len(candidates))]
            if pick != source:
                edits.append(Edit(at, at + len(source), source, pick, rule_id))
    return apply_edits(text, edits)


def dictionary_rewrites(rows: DataFrame, entries: DataFrame, key: str, text: str, *, seed: str, scale: float = 1.0, most_bytes: int = MOST_BYTES) -> DataFrame:
    """key, text (rewritten), edits: each match becomes one of its rule's candidates, drawn by the counter-mode stream of `seed|key`.

    Edits hold source, replacement and places in both texts, so that they can be undone. A null text stays null. A text's matches are part of its row.
    """
    blocks = _blocks(entries, most_bytes)
    own = f"{key} {rows.schema[key].dataType.simpleString()}, {text} string, edits {EDIT}"
    if len(blocks) == 1:
        source, shared = rows.select(key, text), rows.sparkSession.sparkContext.broadcast(blocks[0])
        listed = lambda batch: [[(p, *r) for p, r in shared.value.matches(t or "")] for t in batch.column(1).to_pylist()]
    else:
        rules = entries.groupBy("source").agg(F.min_by(F.struct("rule_id", "candidates", "probability"), "rule_id").alias("r"))
        named = rows.select("*", F.monotonically_increasing_id().alias("_row"))
        named = written(named.select("_row", key, text), "texts")
        found = dictionary_matches(named, entries, "_row", text, most_bytes=most_bytes).join(rules, "source")
        per = found.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "r.rule_id", "source", "r.candidates", "r.probability"))).alias("found"))
        source = named.join(per, "_row", "left").select(key, text, "found")
        listed = lambda batch: [[tuple(m.values()) for m in f or []] for f in batch.column(2).to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, edits = [], []
            for k, t, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), listed(batch)):
                new, placed = rewritten_text(t or "", found, Stream(f"{seed}|{k}"), scale)
                out.append(None if t is None else new)
                edits.append([{"start": e.start, "end": e.end, "source": e.before, "replacement": e.after, "rule_id": e.rule_id, "out_start": e.out_start} for e in placed])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.string()), ("replacement", pa.string()), ("rule_id", pa.string()), ("out_start", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(edits, kind)], names=[key, text, "edits"])

    return source.mapInArrow(run, own)
