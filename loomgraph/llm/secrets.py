"""Secret scans: fixed patterns, and Shannon entropy in sliding windows of candidate strings; built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import let

# Fixed values of the base patterns: kind, Java pattern, group measured, fewest characters.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Segments of a candidate that hold a placeholder or a run of the alphabet, with the separators around; the rest is judged.
PLACEHOLDER = r"[/=_-]*[A-Za-z0-9+]*(?i:example|placeholder|changeme|your[_-]|dummy|lorem|abcdefgh|01234567|12345678|qwertyui)[A-Za-z0-9+]*[/=_-]*"
#: Strings that look random and are not secret: UUIDs, plain numbers, and words, in which no small letter stands alone beside a capital.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9=_/+-]*$",
    r"^(?!.*(?:(?<![a-z])[a-z](?=[A-Z])|(?<=[A-Z])[a-z](?![a-z])))[A-Za-z=_/+-]*$",
)
#: Character classes of candidates: name, pattern of the whole string, window, bits a character that make a window hot.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 16, 3.0), ("alnum", r"^[A-Za-z0-9]+$", 20, 3.6), ("base64", r"^[A-Za-z0-9+/_=-]+$", 20, 3.8))

_SPAN = "array<struct<start:int,end:int>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _running(items: Column, at: Column, kind: str, step, block: int = 128) -> Column:
    """The arrays that step(acc, item) gathers in acc["found"] while it moves acc["at"]; gathered by blocks of items, so that
    the work grows with their number and not with its square."""
    none = F.array().cast(kind)
    blocks = F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / block).cast("int")), lambda b: F.slice(items, b * block + 1, F.lit(block)))).otherwise(F.array())
    begin = F.struct(at.alias("at"), F.array().cast(f"array<{kind}>").alias("blocks"))

    def whole(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("found")), step)
        return let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["blocks"], F.array(x["found"])).alias("blocks")))

    return F.aggregate(blocks, begin, whole, lambda acc: F.flatten(acc["blocks"]))


def _matches(text: Column, pattern: str, group: int, fewest: int) -> Column:
    """Spans in code points of the matches whose group has fewest characters; only run where the pattern is found."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    sizes = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(whole, F.length).alias("whole"), F.transform(part, F.length).alias("part"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["whole"], F.lit(0))
        span = F.array(F.struct(begin.alias("start"), end.alias("end"))).cast(_SPAN)
        return F.struct(end.alias("at"), F.when(x["part"] >= fewest, F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    return let(sizes, lambda z: _running(z, F.lit(0), _SPAN, step))


#: Counts of a window are packed, twelve of five bits in a long: characters of candidates lie in 43 .. 122.
_FIRST, _LAST, _PACKED, _BITS = 43, 122, 12, 5


def hot_windows(string: Column, window: int, bits: float) -> Column:
    """struct(first, last): where in string the first hot window starts and the last one ends; first is null for none.

    The counts of the window's characters, and the sum of c * log2(c), are carried from each window to the next: one
    character comes in and one goes out, whatever the window and the string. A string shorter than the window has none.
    string holds the characters of CANDIDATE only.
    """
    if window >= 1 << _BITS:
        raise ValueError(f"windows of at most {(1 << _BITS) - 1} characters")
    words = -(-(_LAST - _FIRST + 1) // _PACKED)
    logs = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range((1 << _BITS) + 1)])
    ones = F.array(*[F.lit(1 << (_BITS * k)) for k in range(_PACKED)]).cast("array<bigint>")
    right = lambda value, n: F.call_function("shiftright", value, n)

    def place(c: Column) -> Column:
        code = F.ascii(c) - _FIRST
        return F.struct(F.floor(code / _PACKED).cast("int").alias("w"), (code % _PACKED).alias("k"))

    def run(codes: Column) -> Column:
        nothing = F.struct(F.lit(-1).alias("w"), F.lit(0).alias("k"))
        pairs = F.zip_with(codes, F.concat(F.array_repeat(nothing, window), codes), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        begin = F.struct(
            F.array_repeat(F.lit(0).cast("bigint"), words).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")
        )
        count = lambda counts, at: right(F.get(counts, at["w"]), at["k"] * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")

        def step(acc: Column, x: Column) -> Column:
            into, out = x["a"], x["b"]
            full = out["w"] >= 0

            def moved(counts: Column) -> Column:  # one has gone out
                grow = let(count(counts, into), lambda c: F.get(logs, c + 1) - F.get(logs, c))
                shrink = F.when(full, let(count(acc["counts"], out), lambda c: F.get(logs, c) - F.get(logs, c - 1))).otherwise(F.lit(0.0))
                return let(
                    acc["sum"] + grow - shrink,
                    lambda total: let(
                        (acc["n"] + 1 >= window) & (F.lit(math.log2(window)) - total / window >= bits),
                        lambda hot: F.struct(
                            F.transform(counts, lambda c, k: F.when(k == into["w"], c + F.get(ones, into["k"])).otherwise(c)).alias("counts"),
                            total.alias("sum"),
                            (acc["n"] + 1).alias("n"),
                            F.when(hot & acc["first"].isNull(), acc["n"] + 1 - window).otherwise(acc["first"]).alias("first"),
                            F.when(hot, acc["n"] + 1).otherwise(acc["last"]).alias("last"),
                        ),
                    ),
                )

            return let(F.transform(acc["counts"], lambda c, k: F.when(k == out["w"], c - F.get(ones, out["k"])).otherwise(c)), moved)

        taken = F.filter(pairs, lambda p: p["a"].isNotNull())
        return F.aggregate(taken, begin, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return let(F.transform(F.filter(F.split(string, ""), lambda c: c != ""), place), run)


_PIECES = "array<struct<start:int,string:string>>"


def _pieces(start: Column, string: Column) -> Column:
    """What a candidate holds besides its segments of placeholders, in pieces of 20 characters at least."""
    parts = F.arrays_zip(F.split(string, PLACEHOLDER, -1).alias("string"), F.transform(F.regexp_extract_all(string, F.lit(PLACEHOLDER), F.lit(0)), F.length).alias("gap"))

    def step(acc: Column, x: Column) -> Column:
        one = F.array(F.struct(acc["at"].alias("start"), x["string"].alias("string"))).cast(_PIECES)
        at = acc["at"] + F.length(x["string"]) + F.coalesce(x["gap"], F.lit(0))
        return F.struct(at.alias("at"), F.when(F.length(x["string"]) >= 20, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    whole = F.array(F.struct(start.alias("start"), string.alias("string"))).cast(_PIECES)
    return F.when(string.rlike(PLACEHOLDER), let(parts, lambda z: _running(z, start, _PIECES, step))).otherwise(whole)


def _entropy_spans(text: Column) -> Column:
    """Spans of hot windows of the candidate strings, without segments of placeholders, that no allow-list pattern holds."""
    whole, gaps = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)
    zipped = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), whole.alias("string"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        pieces = _pieces(begin, x["string"])
        return F.struct((begin + F.coalesce(F.length(x["string"]), F.lit(0))).alias("at"), F.when(x["string"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], pieces)).alias("found"))

    def random(x: Column) -> Column:
        allowed = F.lit(False)
        for pattern in ALLOWED:
            allowed = allowed | x["string"].rlike(pattern)
        return ~allowed

    def judge(x: Column) -> Column:
        verdict = F.lit(None).cast("struct<first:int,last:int>")
        for _, pattern, window, bits in reversed(CLASSES):
            verdict = F.when(x["string"].rlike(pattern), hot_windows(x["string"], window, bits)).otherwise(verdict)
        return let(verdict, lambda v: F.struct((x["start"] + v["first"]).alias("start"), (x["start"] + v["last"]).alias("end")))

    found = F.filter(let(zipped, lambda z: _running(z, F.lit(0), _PIECES, step)), random)
    return F.filter(F.transform(found, judge), lambda s: s["start"].isNotNull()).cast(_SPAN)


def spans(text: Column) -> Column:
    """Array of (start, rank, kind, end) in code points, by start, then kind: assign, access, hex, entropy."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    found = F.struct(
        F.when(text.rlike(ASSIGN), _matches(text, ASSIGN, 1, 12)).otherwise(_none()).alias("assign"),
        F.when(text.contains("AKIA"), _matches(text, ACCESS, 0, 18)).otherwise(_none()).alias("access"),
        F.when(text.rlike(HEX), _matches(text, HEX, 0, 16)).otherwise(_none()).alias("hex"),
        F.when(text.rlike(CANDIDATE), _entropy_spans(text)).otherwise(_none()).alias("entropy"),
    )
    tag = lambda spans, rank, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    def joined(b: Column) -> Column:
        base = F.concat(tag(b["assign"], 0, "assign"), tag(b["access"], 1, "access"), tag(b["hex"], 2, "hex"))
        return let(base, lambda known: F.sort_array(F.concat(known, F.filter(tag(b["entropy"], 3, "entropy"), lambda e: ~F.exists(known, lambda k: (k["start"] <= e["start"]) & (e["end"] <= k["end"]))))))

    return let(found, joined)


def scan(docs: DataFrame) -> DataFrame:
    """docs with its columns and ``secret_spans``, the spans() of its text; a column of that name is replaced. An entropy
    span inside a base span is left out, since that secret is known.

    Null or empty text: no spans. Null doc_id: scanned, the id is not read. Very long texts are scanned whole, in time that
    grows with their length. Ties: spans of one start come by kind. Repeated rows are scanned each. Empty table: no rows.
    A narrow operation: no shuffle, no Python.
    """
    return docs.withColumn("secret_spans", spans(F.col("text")))


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by mask (overlapping spans by one) and n_chars measured anew where it changed.

    Texts without spans, null ones included, come back unchanged, and so do all other columns and rows, whatever their
    names.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("made"))

    def masked(text: Column, found: Column) -> Column:
        def one(acc: Column, s: Column) -> Column:
            gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["made"]).otherwise(F.concat(acc["made"], gap, F.lit(mask))).alias("made"))

        return F.aggregate(found, start, one, lambda acc: F.concat(acc["made"], F.substring(text, acc["at"] + 1, F.length(text))))

    text = F.col("row.text").cast("string")
    held = docs.select(F.struct("*").alias("row")).withColumn("found", spans(text))
    held = held.withColumn("clean", F.when(F.size("found") > 0, masked(text, F.col("found"))))
    changed = F.col("clean").isNotNull()
    fields = {"text": F.when(changed, F.col("clean")).otherwise(text), "n_chars": F.when(changed, F.length("clean").cast("long")).otherwise(F.col("row.n_chars").cast("long")) if "n_chars" in docs.columns else None}
    return held.select(*[(fields.get(c) if fields.get(c) is not None else F.col("row").getField(c)).alias(c) for c in docs.columns])
