"""Personal data: generators propose spans, boosted trees choose among them.

1. Four base rules (email, ip, card, phone) always hold.
2. Generators propose far more, overlaps included: in every stretch of digits
   and what may stand between them all windows of up to ``GROUPS`` groups, every group of hexadecimal pairs or colons,
   account numbers that begin with a country, addresses whose @ and dots are
   spelled out or fenced in.
3. Boosted trees score each candidate by its format (digits, groups, separators,
   checksums, ranges) and its context (words and characters on either side). They
   are trained on the driver, on ``EXAMPLES`` labelled examples: forms of
   personal data, and numbers and words that look like them, in contexts that
   tell and in contexts that don't.
4. Scores are calibrated on examples held out, and for each kind the threshold is
   the lowest at which, by an exact binomial bound, at least ``PRECISION`` of
   what is told is right. A kind without such a threshold tells nothing more
   than its base rule.
5. Of overlapping spans above their thresholds the longest stays, then the most
   probable; what touches a base span never comes.

Texts without a digit or an @ are done at once, in Arrow. Nothing is shuffled.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import ship_package, text_pieces
from .pii_examples import examples

#: Kinds in the order of their spans; those after the fourth have no base rule.
KINDS = ["email", "ip", "card", "phone", "account", "national_id"]
#: Labelled examples that the trees are fitted on and calibrated with.
EXAMPLES, SEED = 9_000, 13
PRECISION, ERROR = 0.95, 0.05
#: Characters of context that features read on either side.
BESIDE = 40

# The base rules. Possessive where that changes no match, and the
# address from its @, so that long runs of letters or digits take linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "".join(map(chr, [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)])) + "._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _only(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the base rules, in order."""
    out, after = [], 0
    at = text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at)
        begin = after + len(text[after:at].rstrip(_LOCAL))
        if found and begin < at:
            out.append((begin, 0, found.end()))
        after = found.end() if found and begin < at else at + 1
        at = text.find("@", after)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _only(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_only(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# Generators. Each run is bounded, so that a text takes time in proportion.
_NUMBERS = re.compile(r"(?<![0-9A-Za-z])[+(]{0,2}[0-9](?:[0-9]|[\x20().\-/]{1,3}(?=[0-9(]))*+")
_GROUP = re.compile(r"[+(]{0,2}[0-9]+")
#: Groups of digits in a window.
GROUPS = 6
_HEX = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:{1,2}){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")
_FENCED = re.compile(r"(?i)(?<![0-9A-Za-z._%+-])[a-z0-9][a-z0-9._%+-]{0,63}\x20?[\[({<]\x20?at\x20?[\])}>]\x20?[a-z0-9-]{1,63}(?:\x20?(?:\.|[\[({<]\x20?dot\x20?[\])}>])\x20?[a-z0-9-]{1,63}){1,4}")
_SPELLED = re.compile(r"(?i)(?<![0-9A-Za-z._%+-])[a-z0-9][a-z0-9._%+-]{0,63}\x20at\x20[a-z0-9-]{1,63}(?:\x20dot\x20[a-z0-9-]{1,63}){1,4}")
_WIDE = re.compile(r"(?<![\w.])[\w][\w.%+-]{0,63}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,4}")
_HINT = r"(?i:[\[({<]\x20?at\x20?[\])}>]|\x20at\x20[a-z0-9-]{1,63}\x20dot\x20)"
_MORE = r"[0-9@]|[0-9A-Fa-f]:[0-9A-Fa-f:]|" + _HINT


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all candidates; a stretch may be of several kinds."""
    out = []
    for stretch in _NUMBERS.finditer(text):
        groups = [(m.start(), m.end()) for m in _GROUP.finditer(text, *stretch.span())]
        for i, (s, _) in enumerate(groups):
            n = 0
            for j in range(i, min(i + GROUPS, len(groups))):
                e = groups[j][1]
                n += e - groups[j][0] - (text[groups[j][0]] in "+(")
                if n > 19 or e - s > 40:
                    break
                if n < 7 or text[e : e + 1].isalnum():
                    continue
                out += [(s, 3, e)] * (n <= 15) + [(s, 2, e)] * (n >= 12) + [(s, 5, e)] * (8 <= n <= 14) + [(s, 1, e)] * (j == i + 3 and text.count(".", s, e) == 3)
    out += [(m.start(), 1, m.end()) for m in _HEX.finditer(text)]
    out += [(m.start(), 4, m.end()) for m in _IBAN.finditer(text)]
    for pattern in (_FENCED, _SPELLED, _WIDE):
        out += [(m.start(), 0, m.end()) for m in pattern.finditer(text)]
    return out


#: Words near a candidate that tell of each kind, and such as tell against any.
CUES = [
    ["email", "e-mail", "mail", "contact", "write"],
    ["ip", "host", "server", "address", "login", "client", "ping"],
    ["card", "visa", "mastercard", "credit", "debit", "amex", "payment"],
    ["phone", "tel", "telephone", "call", "mobile", "cell", "fax", "whatsapp", "tel."],
    ["iban", "account", "bank", "transfer"],
    ["ssn", "social", "national", "passport", "identity", "taxpayer", "cnp", "insurance"],
    ["isbn", "issn", "doi", "order", "invoice", "version", "release", "page", "pages", "serial", "model", "part", "ref", "tracking", "total", "price", "pp", "vol", "build", "id"],
]
_WORD = re.compile(r"[^\W\d_][\w.-]*")


def _groups(digits: list[str]) -> list[int]:
    return [len(g) for g in digits[:5]] + [0] * (5 - min(len(digits), 5))


def _valid_iban(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 if s.isascii() and s.isalnum() else False


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format and context of one candidate."""
    own = text[start:end]
    digits = _only(own)
    groups = re.findall("[0-9]+", own)
    before, behind = text[max(0, start - BESIDE) : start].lower(), text[end : end + BESIDE].lower()
    near = [w.rstrip(".") for w in _WORD.findall(before)[-4:] + _WORD.findall(behind)[:1]]
    year = any(len(g) == 4 and "1900" <= g <= "2099" for g in groups)
    low = own.lower()
    return [
        *[float(kind == k) for k in range(len(KINDS))],
        float(len(own)),
        float(len(digits)),
        float(len(groups)),
        *map(float, _groups(groups)),
        *[float(own.count(c)) for c in (" ", "-", ".", "/", "(", ":")],
        float(own[:1] == "+"),
        float(own[:1] == "("),
        float(digits[:1] == "0"),
        float(luhn(digits) if len(digits) >= 12 else 0),
        float(all(int(g[:9]) <= 255 for g in groups) if groups else 0),
        float(_valid_iban(own) if kind == 4 else 0),
        float(year),
        float(sum(c.isalpha() for c in own)),
        float(len(set(digits))),
        float("at" in low and any(c in low for c in "[({<")),
        float(" dot " in low or "dot" in low and any(c in low for c in "[({<")),
        float(low.rpartition(".")[2].isalpha() if "." in low else 0),
        *[float(sum(w in cue for w in near)) for cue in CUES],
        float(before[-1:] in ":=#"),
        float(before.rstrip()[-1:] in ":=#"),
        float(before[-1:] in "$€£"),
        float(before[-1:] == "/" or behind[:1] in ("/", "%")),
        float(behind[:1] == "." and behind[1:2].isdigit()),
        float(any(c.isdigit() for c in before[-2:])),
        float(any(c.isdigit() for c in behind[:2])),
        float(before[-1:].isspace() or not before),
        float(behind[:1].isspace() or not behind),
    ]


@lru_cache(maxsize=4)
def trained(n: int = EXAMPLES, seed: int = SEED) -> tuple[boosting.Boosted, tuple[float, ...]]:
    """The trees and the threshold of each kind."""
    rows, r = [], random.Random(seed)
    for text, start, kind, end, right in examples(n, seed):
        rows.append((text, start, kind, end, right))
        # what else is proposed there is none: more than it, or another kind; a part of it may be one
        part = lambda c: right and c[1] == kind and start <= c[0] and c[2] <= end  # noqa: E731, B023
        others = [c for c in proposals(text) if c[0] < end and start < c[2] and c != (start, kind, end) and not part(c)]
        rows += [(text, *c, False) for c in r.sample(others, min(2, len(others)))]
    x = np.array([features(text, s, k, e) for text, s, k, e, _ in rows])
    y = np.array([float(right) for *_, right in rows])
    part = np.arange(len(rows)) % 10
    model = boosting.fit(x[part < 5], y[part < 5])
    boosting.calibrate(model, x[part == 5], y[part == 5])
    held = part > 5
    p, kind = model.probability(x[held]), np.array([r[2] for r in rows])[held]
    cuts = tuple(boosting.threshold(p[kind == k], y[held][kind == k], PRECISION, ERROR / len(KINDS)) for k in range(len(KINDS)))
    return model, cuts


def choose(text: str, base: list[tuple[int, int, int]], model: boosting.Boosted, cuts: tuple[float, ...]) -> list[tuple[int, int, int]]:
    """Spans beyond the base ones."""
    ends = sorted((s, e) for s, _, e in base)
    starts = [s for s, _ in ends]
    reach = np.maximum.accumulate([e for _, e in ends]) if ends else []

    def free(s: int, e: int) -> bool:
        at = np.searchsorted(starts, e)
        return not at or reach[at - 1] <= s

    found = [c for c in proposals(text) if free(c[0], c[2])]
    if not found:
        return []
    p = model.probability(np.array([features(text, *c) for c in found]))
    told = sorted(((-pr, c) for pr, c in zip(p, found) if pr >= cuts[c[1]]), key=lambda t: (t[1][0] - t[1][2], t[0], t[1]))
    taken: list[tuple[int, int]] = []
    out = []
    from bisect import bisect_left, insort

    for _, (s, k, e) in told:
        at = bisect_left(taken, (e, 0))
        if at and taken[at - 1][1] > s:
            continue
        insort(taken, (s, e))
        out.append((s, k, e))
    return sorted(out)


_FOUND = "array<struct<start: int, kind: string, end: int>>"


def scan(docs: DataFrame, n_examples: int = EXAMPLES) -> DataFrame:
    """Personal data in each text.

    Takes (doc_id bigint, text string, ...) and returns (doc_id, base, found),
    one row for each row: arrays of (start, kind, end) in code points, by start
    and then by the order of ``KINDS``. ``base`` has what the four base rules
    find, and ``found`` that and what the trees add. A null or empty text has no
    spans. Rows that repeat an id or a text are scanned one by one; a null id
    stays null; other columns are ignored. A text is scanned whole.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(trained(n_examples))
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def named(spans: list[tuple[int, int, int]]) -> list[dict]:
        return [{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cuts = shared.value
        for piece in text_pieces(batches, "text"):
            column = piece.column("text")
            maybe = pc.fill_null(pc.match_substring_regex(column, _MORE), False).to_pylist()
            base, every = [[]] * len(maybe), [[]] * len(maybe)
            for i, some in enumerate(maybe):
                if some:
                    text = column[i].as_py()
                    own = base_spans(text)
                    base[i] = named(own)
                    every[i] = named(sorted(own + choose(text, own, model, cuts)))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(base, span), pa.array(every, span)], ["doc_id", "base", "found"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, f"doc_id bigint, base {_FOUND}, found {_FOUND}")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with [KIND] in place of each span of its text; where spans overlap
    the first one's kind is told. All columns stay; a null text stays null."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(trained())

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        model, cuts = shared.value
        out = []
        for text in texts.to_pylist():
            if text and re.search(_MORE, text):
                own = base_spans(text)
                parts, at = [], 0
                for s, k, e in sorted(own + choose(text, own, model, cuts)):
                    if s >= at:
                        parts += [text[at:s], f"[{KINDS[k].upper()}]"]
                    at = max(at, e)
                text = "".join(parts) + text[at:]
            out.append(text)
        return pa.array(out, pa.string())

    return docs.withColumn("text", clean(F.col("text"))).select(*docs.columns)
