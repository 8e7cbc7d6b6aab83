"""Text functions: tokens, normal forms, labels and costs, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NOISE = ["the", "and", "not", "for", "with", "that", "this", "test", "tests", "fn"]
STOP = [
    "a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "is", "are", "be", "it", "its", "this", "that", "with", "as", "by", "at",
    "from", "not", "no", "into", "than", "so", "can", "must", "when", "which",
]
GIST_BYTES, GIST_WORDS = 110, 20


def ident_terms(s: Column) -> Column:
    """ASCII identifiers of at least three bytes that are not all digits, in order, case kept."""
    return F.filter(F.split(s, "[^A-Za-z0-9_]"), lambda t: (F.octet_length(t) >= 3) & ~t.rlike("^[0-9]+$"))


def word_terms(s: Column) -> Column:
    """Distinct lower-cased Unicode words of at least three bytes."""
    return F.array_distinct(F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}_]+"), lambda t: F.octet_length(t) >= 3))


def identifier_terms(s: Column) -> Column:
    """Words and their snake and camel parts, lower-cased, without the noise words."""
    raw = F.split(s, r"[^\p{L}\p{N}_]+")
    whole = F.filter(F.transform(raw, F.lower), lambda t: (F.octet_length(t) >= 3) & ~t.rlike(r"^\p{N}+$"))
    parts = F.flatten(F.transform(raw, lambda t: F.split(F.lower(F.regexp_replace(t, r"(\p{Lu})", "_$1")), "_")))
    return F.array_except(F.array_union(whole, F.filter(parts, lambda t: F.octet_length(t) >= 3)), F.array(*map(F.lit, NOISE)))


def label_words(s: Column) -> Column:
    """Distinct lower-cased words of more than one byte without stop words."""
    w = F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}_]"), lambda t: F.octet_length(t) > 1)
    return F.array_except(w, F.array(*map(F.lit, STOP)))


def fold_suffix(s: Column) -> Column:
    """Strips one of ``ing``, ``ed``, ``es``, ``ly``, ``s`` from words that keep three letters."""
    return F.regexp_replace(s, "^(.{3,}?)(ing|ed|es|ly|s)$", "$1")


def search_terms(s: Column) -> Column:
    """Lower-cased Unicode words of at least three bytes with their suffixes folded, in order: what search indexes."""
    words = F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}_]+"), lambda t: F.octet_length(t) >= 3)
    return F.transform(words, fold_suffix)


def flat(s: Column) -> Column:
    """White space collapsed, trimmed, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def normalise_wording(s: Column) -> Column:
    """Alphanumeric words of more than two bytes, lower-cased, joined by spaces."""
    return F.array_join(F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) > 2), " ")


def scrub_ids(s: Column) -> Column:
    """Record labels and 7 to 40 hex digits become ``[id]``."""
    s = F.regexp_replace(s, r"\b[dpqreat]/g[0-9a-f]{12}(r[0-9]+)?(-[0-9]+){1,2}\b", "[id]")
    return F.regexp_replace(s, r"\b[0-9a-f]{7,40}\b", "[id]")


def salvage_json(s: Column) -> Column:
    """A cut-off JSON object closed after its last complete element; null if there is none or it ends in a string."""
    head = F.regexp_extract(s, r"(?s)^(.*\}),", 1)
    bare = F.regexp_replace(head, r'\\.', "")
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"')))
    bare = F.regexp_replace(bare, r'"[^"]*"', "")
    count = lambda ch: F.length(bare) - F.length(F.replace(bare, F.lit(ch)))
    brackets, braces = count("[") - count("]"), count("{") - count("}")
    fixed = F.concat(head, F.repeat(F.lit("]"), brackets), F.repeat(F.lit("}"), braces))
    return F.when((head != "") & (quotes % 2 == 0) & (brackets >= 0) & (braces >= 0), fixed)


def agent_name(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\p{L}\p{N}\-._]", "-")


def clean_label(s: Column) -> Column:
    return F.regexp_replace(F.trim(s), r"^[\[\]]+|[\[\]]+$", "")


def clean_line(s: Column) -> Column:
    """A quoted diff line without its leading marker."""
    return F.trim(F.regexp_replace(s, "^[+-]", ""))


def content_hash(s: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(s, 256), 1, n)


def fingerprint(*parts: Column) -> Column:
    """One hash over ordered parts."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def null_default(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def decision_kind(c: Column) -> Column:
    """A blank kind is an act."""
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit("act")).otherwise(c)


def _start(s: Column) -> Column:
    """The first words, at most 20 of them and 110 bytes."""
    words = F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != "")
    start = F.struct(F.lit("").alias("g"), F.lit(False).alias("full"))

    def add(acc, w):
        over = acc["full"] | (F.octet_length(acc["g"]) + F.octet_length(w) + 1 > GIST_BYTES)
        joined = F.when(acc["g"] == "", w).otherwise(F.concat(acc["g"], F.lit(" "), w))
        return F.struct(F.when(over, acc["g"]).otherwise(joined).alias("g"), over.alias("full"))

    return F.aggregate(F.slice(words, 1, GIST_WORDS), start, add, lambda acc: acc["g"])


def gist(s: Column) -> Column:
    """The first words; `` …`` marks that there is more."""
    g = _start(s)
    return F.when(F.octet_length(g) == F.octet_length(F.trim(s)), g).otherwise(F.concat(g, F.lit(" …")))


def body(s: Column) -> Column:
    """The whole text where the gist is not the whole of it."""
    return F.when(F.octet_length(_start(s)) != F.octet_length(F.trim(s)), F.trim(s))


def paragraphs(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, "\n\n"), lambda p: F.trim(p)), lambda p: p != "")


def one_paragraph(s: Column) -> Column:
    return F.replace(F.array_join(paragraphs(s), " "), F.lit("\n"), F.lit(" "))


def reflowed(s: Column) -> Column:
    """Whether ``one_paragraph`` joins several paragraphs."""
    return F.size(paragraphs(s)) > 1


def first_sentence(s: Column) -> Column:
    """Up to the first full stop followed by a space, or 110 characters."""
    found = F.regexp_extract(s, r"(?s)^(.*?\.) ", 1)
    return F.when(found != "", found).otherwise(F.left(s, F.lit(GIST_BYTES)))


def short_sha(s: Column) -> Column:
    return F.left(s, F.lit(12))


def token_cost(s: Column, chars_per_token: float = 4.0) -> Column:
    return F.ceil(F.octet_length(s) / F.lit(chars_per_token)).cast("long")


def budget_units(tokens: Column, chars_per_token: float = 4.0) -> Column:
    return F.ceil(tokens * F.lit(chars_per_token) / 4).cast("long")


def estimate_minutes(n_bytes: Column) -> Column:
    return F.least(4 + n_bytes / F.lit(1024.0) / 25, F.lit(35.0))


def input_room(window: Column, answer: Column, chars_per_token: Column) -> Column:
    return F.greatest(F.lit(2000.0), (window - answer) * chars_per_token - 4000)


def check_reserve(prompt: Column, view: Column, answer: Column) -> Column:
    """Tokens that a check keeps free of records: the prompt's, the view's and the answer's."""
    return prompt + view + answer


def check_budget(reserve: Column, budget: Column, window: Column) -> Column:
    """What prompt, view, answer and packed records may take together: as much as the window holds, and at least 512
    tokens beyond the reserve."""
    return F.least(reserve + budget, F.greatest(window, reserve + 512))


def is_prose_path(path: Column) -> Column:
    """A file that says what exists rather than doing it."""
    p = F.lower(path)
    return (p == "<message>") | p.rlike(r"\.(md|txt|rst)$") | p.rlike("^(docs|documentation)/") | p.rlike("changelog|release[_-]notes")


def compose_label(prefix: Column, sha: Column, run: Column, *numbers: Column) -> Column:
    """``<prefix>/g<sha12>[r<run>]-<d>[-<n>]``; null numbers are left out."""
    stem = F.concat(prefix, F.lit("/g"), F.lower(short_sha(sha)), F.when(run > 0, F.concat(F.lit("r"), run.cast("string"))).otherwise(F.lit("")))
    return F.concat_ws("-", stem, *[n.cast("string") for n in numbers])


LABEL = r"^([dpqreat])/g([0-9a-f]{12})(?:r([0-9]+))?-([0-9]+)(?:-([0-9]+))?$"


def parse_label(label: Column) -> Column:
    """Struct kind, sha12, run, d, n of a label; nulls where it is none."""
    get = lambda i: F.nullif(F.regexp_extract(label, LABEL, i), F.lit(""))
    ok = label.rlike(LABEL)
    return F.struct(
        F.when(ok, get(1)).alias("kind"), F.when(ok, get(2)).alias("sha12"), F.when(ok, F.coalesce(get(3).cast("int"), F.lit(0))).alias("run"),
        F.when(ok, get(4).cast("int")).alias("d"), F.when(ok, get(5).cast("int")).alias("n"),
    )


def change_reason(item: Column, file: Column, moved: Column) -> Column:
    return F.when(moved == "changed", F.format_string("%s changed in %s", item, file)).when(
        moved == "gone", F.format_string("%s is no longer in %s", item, file)
    )


def assign_source(place: Column, sha: Column) -> Column:
    """``git:<sha>`` for a message quote, ``<path>@<sha12>`` for one in a file."""
    return F.when(place == "<message>", F.concat(F.lit("git:"), sha)).otherwise(F.concat(place, F.lit("@"), short_sha(sha)))


def source_path(source: Column) -> Column:
    return F.nullif(F.regexp_extract(source, "^(.*)@[^@]*$", 1), F.lit(""))


def claim_text(gist_: Column, body_: Column) -> Column:
    return F.concat_ws(" ", gist_, body_)
