"""Responses of single steps: their shapes as codes, and the lenient reading of a reconstruction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that a response may use. Fixed values.
TASK1_KEYS = ("confidence", "intent", "reconstructed_entry", "reconstructed_text", "uncertainties")
TASK1_INTENTS = ("OPEN_SITE", "ADD_ACCOUNT", "SEARCH_QUERY", "ENTER_CODE", "CONTACT_SERVICE", "UNKNOWN", "OPEN_CONTROLLED_SITE_AND_INSPECT")
RESERVED_ENTRY = r"(?i)\Ahttps://case-[0-9a-f]{20}\.test/start\z"
JUDGMENT_KEYS = ("answer", "counterevidence", "evidence", "evidence_sufficiency", "intent", "risk_reason")
PLATFORMS = ("bilibili", "douyin", "wechat", "wechat_channels", "qq", "weibo", "baidu_tieba", "tiktok", "unknown")
NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"
CANDIDATES = "array<struct<value:string,rank:int,confidence:double>>"


def _part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _text(v: Column, path: str) -> Column:
    """The string at a path; null for anything else."""
    return F.when(F.schema_of_variant(_part(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def _list(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _keys(v: Column) -> Column:
    return F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))


def _are(keys: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(keys == F.array(*[F.lit(n) for n in names]), F.lit(False))


def _broken(tests: dict[str, Column]) -> Column:
    """Sorted codes whose test holds; null is no."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(c)) for c, t in tests.items()])))


def task1_codes(raw: Column) -> Column:
    """Codes of a reconstruction of one text, from its JSON; what isn't JSON breaks every rule that needs a value."""
    v = F.try_parse_json(raw)
    keys, kind = _keys(v), F.schema_of_variant(_part(v, "$.confidence"))
    confidence = F.try_variant_get(v, "$.confidence", "double")
    share = F.coalesce((kind == "BOOLEAN") | kind.rlike(NUMBER) & (confidence >= 0) & (confidence <= 1), F.lit(False))
    return _broken({
        "TASK1_KEYS_INVALID": ~(_are(keys, TASK1_KEYS) | _are(keys, tuple(k for k in TASK1_KEYS if k != "reconstructed_text"))),
        "TASK1_RECONSTRUCTED_TEXT_INVALID": F.array_contains(keys, "reconstructed_text") & _text(v, "$.reconstructed_text").isNull(),
        "TASK1_INTENT_INVALID": ~F.coalesce(_text(v, "$.intent").isin(*TASK1_INTENTS), F.lit(False)), "TASK1_CONFIDENCE_INVALID": ~share,
        "TASK1_UNCERTAINTIES_INVALID": _list(v, "$.uncertainties").isNull(), "TASK1_RESERVED_ENTRY_GRAMMAR_INVALID": ~F.coalesce(F.try_variant_get(v, "$.reconstructed_entry", "string").rlike(RESERVED_ENTRY), F.lit(False)),
    })


def judgment_shape_codes(raw: Column, known: Column) -> Column:
    """Codes of a judgment's shape, and of the evidence that it cites against an array of known ids."""
    v = F.try_parse_json(raw)
    listed = _list(v, "$.evidence")
    cited = F.filter(listed, lambda x: _are(_keys(x), ("evidence_id", "observation")))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return _broken({
        "JUDGMENT_KEYS_INVALID": ~_are(_keys(v), JUDGMENT_KEYS), "JUDGMENT_ANSWER_INVALID": ~F.coalesce(_text(v, "$.answer").isin("YES", "NO", "INSUFFICIENT"), F.lit(False)),
        "JUDGMENT_SUFFICIENCY_INVALID": ~F.coalesce(_text(v, "$.evidence_sufficiency").isin("SUFFICIENT", "INSUFFICIENT"), F.lit(False)), "JUDGMENT_REASON_INVALID": blank(_text(v, "$.risk_reason")),
        "JUDGMENT_EVIDENCE_INVALID": listed.isNull(), "JUDGMENT_EVIDENCE_EMPTY": F.size(listed) == 0, "JUDGMENT_EVIDENCE_ITEM_INVALID": F.size(cited) < F.size(listed),
        "JUDGMENT_UNKNOWN_EVIDENCE_ID": F.exists(cited, lambda x: ~F.coalesce(F.array_contains(known, _text(x, "$.evidence_id")), F.lit(False))), "JUDGMENT_EMPTY_OBSERVATION": F.exists(cited, lambda x: blank(_text(x, "$.observation"))),
        "JUDGMENT_COUNTEREVIDENCE_INVALID": _list(v, "$.counterevidence").isNull(),
    })


def lenient_reconstruction(raw: Column, ids: Column, *, limit: int = 5) -> Column:
    """struct<failure, messages, candidates, intent, platform, abstain, uncertainties>: the lenient reading against the task's message ids.

    A single reconstructed_text may stand for the list of messages, entry for a candidate's value, intent_label for intent; candidates are ranked by their place and
    have confidence 0.5 where none is given. failure tells the first thing that can't be read so, and is null for a good response.
    """
    v = F.try_parse_json(raw)
    keys = F.coalesce(_keys(v), F.array().cast("array<string>"))
    has = lambda name: F.array_contains(keys, name)
    empty = lambda path: F.coalesce(F.to_json(_part(v, path)).isin("null", "false", "0", '""', "[]", "{}"), F.lit(True))
    single = _text(v, "$.reconstructed_text")
    one = empty("$.reconstructed_messages") & single.isNotNull()
    rows, message = _list(v, "$.reconstructed_messages"), "array<struct<message_id:string,text:string>>"
    read = F.transform(rows, lambda x: F.struct(F.when(F.to_json(_part(x, "$.message_id")).isin("0", "false", "null"), "").otherwise(F.coalesce(F.try_variant_get(x, "$.message_id", "string"), F.lit(""))).alias("message_id"), _text(x, "$.text").alias("text")))
    messages = F.when(one, F.array(F.struct(F.get(ids, F.lit(0)).alias("message_id"), single.alias("text")))).otherwise(read).cast(message)
    given = F.when(empty("$.entry_candidates"), F.array().cast("array<variant>")).otherwise(_list(v, "$.entry_candidates"))
    first = F.slice(given, 1, limit)
    value = lambda x: F.when(F.array_contains(_keys(x), "value"), _text(x, "$.value")).otherwise(_text(x, "$.entry"))
    told = lambda x: F.array_contains(_keys(x), "confidence")
    share = lambda x: F.when(F.schema_of_variant(_part(x, "$.confidence")).rlike(NUMBER), F.try_variant_get(x, "$.confidence", "double"))
    candidates = F.transform(first, lambda x, i: F.struct(value(x).alias("value"), (i + 1).alias("rank"), F.when(told(x), share(x)).otherwise(F.lit(0.5)).alias("confidence"))).cast(CANDIDATES)
    # the first candidate that can't be read tells how
    fault = F.transform(first, lambda x: F.when(_keys(x).isNull(), "entry candidate is not an object").when(value(x).isNull(), "entry candidate has no string value").when(told(x) & ~F.coalesce((share(x) >= 0) & (share(x) <= 1), F.lit(False)), "entry candidate confidence is invalid"))
    intent = F.when(has("intent"), _text(v, "$.intent")).otherwise(_text(v, "$.intent_label"))
    platform = _text(v, "$.platform")
    abstain = F.when(F.schema_of_variant(_part(v, "$.abstain")) == "BOOLEAN", F.try_variant_get(v, "$.abstain", "boolean"))
    doubts = _list(v, "$.uncertainties")
    failure = (
        F.when(~(has("reconstructed_messages") | has("reconstructed_text")), "response lacks reconstructed_messages or reconstructed_text")
        .when(one & (F.size(ids) != 1), "single reconstructed_text cannot represent multiple messages").when(~one & rows.isNull(), "reconstructed_messages is not a list")
        .when(F.exists(messages, lambda m: m["text"].isNull()), "invalid reconstructed message").when(~F.transform(messages, lambda m: m["message_id"]).eqNullSafe(ids), "reconstructed message IDs differ from the input")
        .when(given.isNull(), "entry_candidates is not a list").when(F.exists(fault, lambda f: f.isNotNull()), F.get(F.filter(fault, lambda f: f.isNotNull()), F.lit(0)))
        .when(intent.isNull(), "intent is not a string").when(~F.coalesce(platform.isin(*PLATFORMS), F.lit(False)), "platform is invalid").when(abstain.isNull(), "abstain is not a boolean")
        .when(doubts.isNull() | F.exists(doubts, lambda d: F.schema_of_variant(d) != "STRING"), "uncertainties is not a string array")
    )
    return F.struct(
        failure.alias("failure"), messages.alias("messages"), candidates.alias("candidates"), intent.alias("intent"), platform.alias("platform"), abstain.alias("abstain"),
        F.transform(doubts, lambda d: F.try_variant_get(d, "$", "string")).alias("uncertainties"),
    )
