"""Scalar functions over text, paths, dates and statuses, as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..runtime import let

# Letters that Turkish folding maps one to one, and endings that light stemming strips, longest first.
TURKISH = ("çğıöşüâîûÇĞİÖŞÜÂÎÛI", "cgiosuaiuCGIOSUAIUI")
ENDINGS = ("ations", "ation", "ings", "ing", "ers", "ies", "ed", "er", "es", "ly", "s")
LANGUAGE_SUFFIXES = {
    "python": (".py", ".pyi"),
    "javascript": (".js", ".jsx", ".mjs"),
    "typescript": (".ts", ".tsx"),
    "java": (".java",),
    "kotlin": (".kt", ".kts"),
    "scala": (".scala",),
    "groovy": (".groovy", ".gradle"),
    "go": (".go",),
    "rust": (".rs",),
    "cpp": (".cpp", ".cc", ".hpp", ".h"),
    "csharp": (".cs",),
    "ruby": (".rb",),
    "shell": (".sh", ".bash"),
    "sql": (".sql",),
    "markdown": (".md",),
    "yaml": (".yaml", ".yml"),
}
LANGUAGE_ALIASES = {"py": "python", "js": "javascript", "ts": "typescript", "kt": "kotlin", "rs": "rust", "c++": "cpp", "cs": "csharp", "rb": "ruby", "sh": "shell", "md": "markdown", "yml": "yaml"}


def fold_tr(text: Column) -> Column:
    """Turkish letters as ASCII, then lower case; as long as before."""
    return F.lower(F.translate(text, *TURKISH))


def split_identifier(name: Column) -> Column:
    """The parts of a snake, camel or digit compound, in lower case."""
    parts = F.regexp_extract_all(name, F.lit(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0))
    return F.transform(parts, lambda p: F.lower(p))


def stem(word: Column) -> Column:
    """word without its first fitting ending, if at least three letters stay."""
    out = word
    for end in reversed(ENDINGS):
        out = F.when(word.endswith(end) & (F.length(word) >= len(end) + 3), F.substring(word, F.lit(1), F.length(word) - len(end))).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))


def word_tokens(name: Column) -> Column:
    """An identifier's whole lower-case form and the stems of its parts, distinct."""
    return F.array_distinct(F.concat(F.array(F.lower(name)), F.transform(split_identifier(name), stem)))


def norm_label(label: Column) -> Column:
    """Lower case; every run of other than letters and digits is one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def character_runs(text: Column, k: int) -> Column:
    """Every run of k characters, in order, in time linear in the text; none for a shorter text."""

    def run(chars: Column) -> Column:
        out = chars
        for i in range(1, k):
            out = F.zip_with(out, F.slice(chars, i + 1, F.greatest(F.size(chars) - i, F.lit(0))), lambda a, b: F.concat(a, b))
        return F.filter(out, lambda x: x.isNotNull())

    return let(F.split(text, ""), run)


def shingles(text: Column, k: int = 3) -> Column:
    """Distinct runs of k characters; the whole text if it is shorter."""
    short = F.when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(text) <= k, short).otherwise(F.array_distinct(character_runs(text, k)))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    n = F.length(text)
    per = F.transform(F.array_distinct(F.split(text, "")), lambda c: n - F.length(F.replace(text, c, F.lit(""))))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(F.filter(per, lambda c: c > 0), F.lit(0.0), lambda acc, c: acc - (c / n) * F.log2(c / n)))


def clip(text: Column, n: int) -> Column:
    """One line of at most n characters, an ellipsis marking a cut."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(line) <= n, line).otherwise(F.concat(F.substring(line, 1, n - 1), F.lit("…")))


def clip_middle(text: Column, n: int) -> Column:
    """At most n characters, cut in the middle."""
    head = (n - 1) // 2
    tail = n - 1 - head
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("…"), F.substring(text, -tail, tail)))


#: Rows that a Python worker normalises at once.
NFC_ROWS = 64


@F.arrow_udf(StringType())
def _composed(text: pa.Array) -> pa.Array:
    made = [pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in text.slice(i, NFC_ROWS).to_pylist()], pa.string()) for i in range(0, len(text), NFC_ROWS)]
    return pa.concat_arrays(made) if made else pa.array([], pa.string())


def nfc(text: Column) -> Column:
    """Unicode normal form C (no built-in has it). Characters below U+0300 neither compose nor change, so a text of such only
    stays in the JVM; of the others a worker holds NFC_ROWS at a time as Python strings."""
    changes = text.rlike(r"[^\x{0}-\x{2FF}]")
    return F.coalesce(_composed(F.when(changes, text)), text)


@F.pandas_udf(StringType())
def strip_marks(text: pd.Series) -> pd.Series:
    """Without combining marks."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def content_id(text: Column) -> Column:
    """sha256 of a text with line ends made alike."""
    return F.sha2(F.regexp_replace(text, "\r\n", "\n"), 256)


def tree_id(pairs: Column) -> Column:
    """sha256 over sorted (path, hash) structs."""
    return F.sha2(F.array_join(F.transform(F.sort_array(pairs), lambda p: F.concat(p["path"], F.lit("\0"), p["hash"])), "\n"), 256)


def member_fingerprint(members: Column) -> Column:
    """The first 16 hex digits of sha256 over sorted ids, each followed by a NUL."""
    return F.substring(F.sha2(F.array_join(F.transform(F.sort_array(members), lambda m: F.concat(m, F.lit("\0"))), ""), 256), 1, 16)


def tokens_estimate(chars: Column) -> Column:
    return F.ceil(chars / F.lit(4)).cast("long")


def folder(path: Column, depth: int | None = None) -> Column:
    """The folder of a path, its first ``depth`` parts if given; "." at the top."""
    parts = F.split(path, "/")
    own = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    if depth is not None:
        own = F.slice(own, 1, depth)
    return F.when(F.size(own) == 0, F.lit(".")).otherwise(F.array_join(own, "/"))


def extension(path: Column) -> Column:
    found = F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))
    return F.when(found == "", F.lit("(none)")).otherwise(found)


def is_test_file(path: Column) -> Column:
    return F.coalesce(path.rlike(r"(^|/)tests?/|(^|/)test_[^/]*$|[._-](test|spec)s?\.[^/.]+$"), F.lit(False))


def is_vendored(path: Column) -> Column:
    return F.coalesce(path.rlike(r"(^|/)(vendor|vendored|node_modules|third_party|site-packages)/"), F.lit(False))


def is_generated(path: Column) -> Column:
    return F.coalesce(path.rlike(r"(_pb2|\.pb|\.g|\.generated)\.[^/.]+$|(^|/)generated/"), F.lit(False))


def is_minified(path: Column) -> Column:
    return F.coalesce(path.rlike(r"\.min\.(js|css)$"), F.lit(False))


def language(path: Column) -> Column:
    out = F.lit("other")
    for name, suffixes in LANGUAGE_SUFFIXES.items():
        out = F.when(extension(path).isin(*suffixes), F.lit(name)).otherwise(out)
    return out


def file_class(path: Column) -> Column:
    """code, document, paper, image or video, by extension; null for others."""
    e = extension(path)
    code = [s for n, xs in LANGUAGE_SUFFIXES.items() if n not in ("markdown", "yaml") for s in xs]
    return (
        F.when(e.isin(*code), "code")
        .when(e.isin(".md", ".txt", ".rst", ".html", ".yaml", ".yml"), "document")
        .when(e == ".pdf", "paper")
        .when(e.isin(".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp"), "image")
        .when(e.isin(".mp4", ".mov", ".webm", ".mkv"), "video")
    )


def detect_language(text: Column) -> Column:
    """tr, en, mixed or other, from Turkish letters and a few function words of each."""
    low = F.lower(text)
    turkish = F.regexp_count(low, F.lit(r"[çğışöü]|\b(ve|bir|bu|için|ile|nasıl|nerede|ne)\b"))
    english = F.regexp_count(low, F.lit(r"\b(the|and|of|is|to|in|how|what|where|which)\b"))
    return F.when((turkish > 0) & (english > 0), "mixed").when(turkish > 0, "tr").when(english > 0, "en").otherwise("other")


def failure_key(message: Column, coarse: bool = False) -> Column:
    """A failure message without addresses, UUIDs, durations and temporary paths (coarse: without numbers), hashed."""
    m = F.regexp_replace(message, r"0x[0-9a-fA-F]+", "<addr>")
    m = F.regexp_replace(m, r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", "<uuid>")
    m = F.regexp_replace(m, r"\b\d+(?:\.\d+)?\s?(?:ms|s|sec|seconds|minutes)\b", "<time>")
    m = F.regexp_replace(m, r"(?:/tmp|/var/folders)/\S+", "<tmp>")
    if coarse:
        m = F.regexp_replace(m, r"\d+", "<n>")
    return F.substring(F.sha2(F.trim(F.regexp_replace(m, r"\s+", " ")), 256), 1, 16)


STATUS_RANK = {"statically_verified": 0, "strong_inference": 1, "weak_inference": 2, "unknown": 3}


def status_rank(status: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv]), status), F.lit(3))


def rank_status(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATUS_RANK]), rank + 1)


def weaker(a: Column, b: Column) -> Column:
    return rank_status(F.greatest(status_rank(a), status_rank(b)))


def step_down(status: Column) -> Column:
    return rank_status(F.least(status_rank(status) + 1, F.lit(3)))


# What is scrubbed from text.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def redact(text: Column) -> Column:
    """E-mail addresses, bearer tokens and keyed secrets replaced."""
    t = F.regexp_replace(text, EMAIL, "[email]")
    t = F.regexp_replace(t, r"(?i)bearer\s+[A-Za-z0-9._-]{16,}", "Bearer [secret]")
    return F.regexp_replace(t, r"""(?i)((?:password|secret|token|api_?key)["']?\s*[:=]\s*["']?)[A-Za-z0-9+/_.=-]{12,}""", "$1[secret]")


def sql_tables(text: Column) -> Column:
    """Names after FROM, JOIN, INTO, UPDATE and TABLE, comments and strings blanked, in lower case."""
    # one pass from left to right: what opens first, a string or a comment, hides the other
    bare = F.regexp_replace(text, r"'[^']*'|-{2}[^\n]*|(?s:/[*].*?[*]/)", " ")
    return F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(r"(?i)\b(?:from|join|into|update|table)\s+([a-z_][a-z0-9_.]*)"), F.lit(1)), lambda x: F.lower(x)))
