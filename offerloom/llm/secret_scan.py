"""Secret scans with linking of multipart credentials.

All of it is DataFrame expressions. A pattern's spans come from splitting the
text at its matches: the lengths of the pieces between and of the matches add up
to the offsets. Strong kinds are reported wherever they match. Weak parts (an
account name, a short or bare secret, an endpoint) are reported only when parts
that complete them lie within ``SCOPE`` code points: an interval join on blocks
of the text, as a semi-join, so that a part is told once whatever its number of
partners.

Expressions that carry a sum or a maximum along an array do so within runs of a
bounded length, the runs' own totals first, so that a text with a million spans
costs little more for each than one with ten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_ids, hot_limit, join_one_row_per_key, keep_ids, materialize, row_id

#: The strong kinds, in order; group and least length that count.
STRONG = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: A text without these (in lower case for ``assign``) cannot match.
HINTS = {"assign": ["passw", "secret", "token", "api_key", "apikey"], "access": ["akia"]}

#: Weak parts: pattern, hints in lower case.
WEAK = {
    "account": (r"""(?i)(?<![A-Za-z0-9])(?:user_?name|user|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", ["user", "login", "client", "account", "access"]),
    "phrase": (r"""(?i)(?<![A-Za-z0-9])(?:pwd|passphrase|pass|credential|private_?key|auth)["']?\x20*[:=]\x20*["']?[^\s"']{4,}""", ["pwd", "pass", "credential", "private", "auth"]),
    "bare": (r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])", None),
    "endpoint": (r"""(?i)(?<![A-Za-z0-9])(?:https?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|ftps?|sftp|ssh|s3)://[^\s"'<>]+""", ["://"]),
}
ORDER = [*STRONG, *WEAK]
ROLE = {"assign": "secret", "hex": "secret", "phrase": "secret", "bare": "secret", "access": "id", "account": "id", "endpoint": "endpoint"}
SCOPE = 200
BLOCK = 1024

_SPAN = "array<struct<start:int,end:int>>"


#: Elements of an array in a run.
RUN = 512


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _carried(rows: Column, value, join, emit) -> Column:
    """flatten(emit(row, what value() of all rows before it join()s to)).

    ``value`` gives an int of a row, ``join`` puts two ints together and is
    associative with 0 as its unit.
    """
    zero = F.lit(0)

    def along(items: Column, start: Column, of) -> Column:
        """What stands before each item, as an array."""
        begin = F.struct(start.alias("at"), F.array().cast("array<int>").alias("seen"))
        step = lambda acc, x: F.struct(join(acc["at"], of(x)).alias("at"), F.concat(acc["seen"], F.array(acc["at"])).alias("seen"))
        return F.aggregate(items, begin, step)["seen"]

    def cut(rows: Column) -> Column:
        last = F.greatest(F.ceil(F.size(rows) / RUN).cast("int") - 1, zero)
        return F.transform(F.sequence(zero, last), lambda k: F.slice(rows, k * RUN + 1, RUN))

    def carry(runs: Column) -> Column:
        whole = F.transform(runs, lambda run: F.aggregate(run, zero, lambda at, r: join(at, value(r))))
        placed = F.arrays_zip(runs.alias("run"), along(whole, zero, lambda x: x).alias("start"))
        return F.flatten(F.transform(placed, lambda x: _let(along(x["run"], x["start"], value), lambda before: emit(x["run"], before))))

    return _let(rows, lambda rows: _let(cut(rows), carry))


def _offsets(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, end>> of the matches whose group is long enough."""
    gaps = F.transform(F.split(text, pattern), lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.arrays_zip(gaps.alias("gap"), F.transform(found, lambda x: F.length(x)).alias("size"), F.transform(held, lambda x: F.length(x) >= least).alias("ok"))

    def spans(run: Column, before: Column) -> Column:
        at = lambda r, i: F.get(before, i) + r["gap"]
        every = F.transform(run, lambda r, i: F.struct(at(r, i).alias("start"), (at(r, i) + r["size"]).alias("end"), r["ok"].alias("ok")))
        return F.transform(F.filter(every, lambda s: s["ok"]), lambda s: F.struct(s["start"], s["end"]))

    return _carried(rows, lambda r: r["gap"] + F.coalesce(r["size"], F.lit(0)), lambda a, b: a + b, spans)


def _hinted(lower: Column, hints: list[str]) -> Column:
    out = F.lit(False)
    for h in hints:
        out = out | lower.contains(h)
    return out


def _found(docs: DataFrame) -> DataFrame:
    """``docs`` (with text) plus a column of spans for each kind."""
    none = F.array().cast(_SPAN)
    docs = docs.withColumn("lower", F.lower("text"))
    out = {}
    for kind, (pattern, group, least) in STRONG.items():
        maybe = _hinted(F.col("lower"), HINTS[kind]) if kind in HINTS else F.col("text").rlike(r"[0-9a-f]{32}")
        # a run of hex digits is one match, so asking for 32 at once leaves the same ones
        exact = r"[0-9a-f]{32,}" if kind == "hex" else pattern
        out[kind] = F.when(maybe, _offsets(F.col("text"), exact, group, least)).otherwise(none)
    for kind, (pattern, hints) in WEAK.items():
        maybe = _hinted(F.col("lower"), hints) if hints else F.col("text").rlike(r"[A-Za-z0-9+/]{40}")
        out[kind] = F.when(maybe, _offsets(F.col("text"), pattern, 0, 1)).otherwise(none)
    return docs.select([c for c in docs.columns if c != "lower"] + [v.alias(k) for k, v in out.items()])


def _labelled(kinds: list[str]) -> Column:
    """One array<struct<start, rank, end>> of the spans of several kinds."""

    def ranked(kind: str) -> Column:
        rank = F.lit(ORDER.index(kind)).alias("rank")
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), rank, s["end"].alias("end")))

    return F.concat(*map(ranked, kinds))


def _told(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Secrets of each text.

    Takes (doc_id bigint, text, ...) and returns (doc_id, n_assign, n_access,
    n_hex, base_sha256, spans, found), one row for each row. ``found`` is an
    array of (start, rank, end) and ``spans`` the same as text, kind:start:end
    in code points, sorted by start and kind; base_sha256 is the digest of the
    strong ones alone. Weak parts that overlap a strong one are not told, but
    complete others. A null or empty text has no spans. Rows that repeat an id
    and text get the same result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = _found(docs.withColumn("rid", row_id(F.col("doc_id"), F.col("text")))).drop("text")
    # ``place`` tells equal rows apart where they must be dealt out
    found = found.select("doc_id", "rid", F.monotonically_increasing_id().alias("place"), *STRONG, _labelled(list(STRONG)).alias("strong"), _labelled(list(WEAK)).alias("weak"))
    found = materialize(found, "secrets")

    role = F.get(F.array(*[F.lit(ROLE[k]) for k in ORDER]), F.col("rank"))
    held = found.filter(F.size("weak") > 0)
    parts = held.select("rid", F.explode(F.concat("strong", "weak")).alias("s")).select("rid", "s.*").distinct()
    parts = materialize(parts.withColumn("role", role), "parts")
    blocks = lambda lo, hi: F.explode(F.sequence(F.floor(lo / BLOCK), F.floor(hi / BLOCK)))
    weak = parts.filter(F.col("rank") >= len(STRONG))
    strong = parts.filter(F.col("rank") < len(STRONG)).withColumn("block", blocks(F.col("start"), F.col("end"))).alias("p")
    spread = weak.withColumn("block", blocks(F.col("start"), F.col("end"))).alias("w")
    over = (F.col("w.rid") == F.col("p.rid")) & (F.col("w.block") == F.col("p.block")) & (F.col("p.start") < F.col("w.end")) & (F.col("w.start") < F.col("p.end"))
    covered = spread.join(strong, over, "left_semi").select("rid", "start", "rank", "end").distinct()
    own = materialize(weak.join(covered, ["rid", "start", "rank", "end"], "left_anti"), "weak")
    reach = own.withColumn("block", blocks(F.greatest(F.col("start") - SCOPE, F.lit(0)), F.col("end") + SCOPE)).alias("w")

    def beside(want: str) -> DataFrame:
        """Weak parts with a part of the role ``want`` in their scope."""
        other = parts.filter(F.col("role") == want).withColumn("block", blocks(F.col("start"), F.col("end"))).alias("p")
        near = (F.col("w.rid") == F.col("p.rid")) & (F.col("w.block") == F.col("p.block")) & (F.col("p.start") <= F.col("w.end") + SCOPE) & (F.col("p.end") >= F.col("w.start") - SCOPE)
        return reach.filter(F.col("role") != want).join(other, near, "left_semi").select("rid", "start", "rank", "end", "role", F.lit(want).alias("with"))

    linked = beside("secret").union(beside("id")).union(beside("endpoint")).groupBy("rid", "start", "rank", "end", "role").agg(F.collect_set("with").alias("with"))
    has = lambda r: F.array_contains("with", r)
    complete = F.when(F.col("role") == "id", has("secret")).when(F.col("role") == "secret", has("id") | has("endpoint")).otherwise(has("id") & has("secret"))
    told = linked.filter(complete).groupBy("rid").agg(F.collect_list(F.struct("start", "rank", "end")).alias("more"))

    told = told.join(held.groupBy("rid").agg(F.count(F.lit(1)).alias("rows")), "rid")
    out = join_one_row_per_key(found, told, ["rid"], "rows", hot_limit(found.count()), "place", how="left")
    out = out.withColumn("found", F.sort_array(F.when(F.col("more").isNull(), F.col("strong")).otherwise(F.concat("strong", "more"))))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in STRONG]
    return out.select("doc_id", *counts, F.sha2(_told(F.col("strong")), 256).alias("base_sha256"), _told(F.col("found")).alias("spans"), "found", "rid")


def redact(docs: DataFrame, marker: str = "[SECRET]") -> DataFrame:
    """``docs`` with ``marker`` in place of each reported span of its text.

    Overlapping spans become one marker. A null text stays null; all columns
    stay as they are.
    """
    found = scan(docs).filter(F.size("found") > 0).groupBy(F.col("rid").alias("__rid")).agg(F.first("found").alias("__found"), F.count(F.lit(1)).alias("__rows"))
    found = materialize(found, "redactions")
    keyed = docs.withColumns({"__rid": row_id(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit(""))), "__place": F.monotonically_increasing_id()})
    hot = hot_limit(found.agg(F.sum("__rows")).first()[0] or 0)
    joined = join_one_row_per_key(keep_ids(keyed, found, "__rid"), found, ["__rid"], "__rows", hot, "__place")

    def pieces(run: Column, before: Column) -> Column:
        """The text before each span of a run, from the end of those before it."""
        # a position is found by reading from the start: of the run's stretch here
        first = F.get(before, 0)
        stretch = F.array(F.substring(F.col("text"), first + 1, F.greatest(F.element_at(run, -1)["end"] - first, F.lit(0))))
        gap = lambda t, s, i: F.concat(F.substring(t, F.get(before, i) - first + 1, s["start"] - F.get(before, i)), F.lit(marker))
        cut = lambda t: F.transform(run, lambda s, i: F.when(s["start"] >= F.get(before, i), gap(t, s, i)).otherwise(""))
        return F.get(F.transform(stretch, cut), F.lit(0))

    cuts = _carried(F.col("__found"), lambda s: s["end"], lambda a, b: F.greatest(a, b), pieces)
    rest = F.substring(F.col("text"), F.array_max(F.transform("__found", lambda s: s["end"])) + 1, F.length("text"))
    done = joined.withColumn("text", F.concat(F.array_join(cuts, ""), rest)).select(*docs.columns)
    return drop_ids(keyed, found, "__rid").select(*docs.columns).unionByName(done)
