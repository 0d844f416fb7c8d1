"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for each document; the ledger stores the measurements and one failure
bit for each rule.  A policy is a versioned mask over those bits: applying another version, or
leaving a rule out (ablation), reads the ledger and never the texts.

Null and empty texts have no words and no lines; very long ones are measured whole.  Repeated rows and
ties are judged each alone; extra columns are ignored (``passing`` keeps them, whatever their names); an
empty table gives an empty ledger.  There is no shuffle and no join: a document is measured in its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as the rules know it: \x20 and \x09 to \x0D.
_SPACE = r"concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and binds it in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_WORDS = f"CASE WHEN trim(BOTH {_SPACE} FROM text) = '' THEN array() ELSE split(trim(BOTH {_SPACE} FROM text), '[\\\\x20\\\\x09-\\\\x0D]+') END"

# Windows of three words as (hash, place) in order: equal windows are neighbours.  The places of windows
# that have an equal neighbour are put in order; each covers three words, less what the next one covers too.
# Where neighbours of one hash differ in words (a collision), the row's windows are sorted with their words.
_COVERED = "aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> least(3, b - a)), 0L, (n, x) -> n + x)"
_PLACES = "greatest(size(v) - 2, 0)"
_BY_WORDS = f"sort_array(transform(slice(v, 1, {_PLACES}), (x, i) -> struct(x AS a, get(v, i + 1) AS b, get(v, i + 2) AS c, i AS i)))"
_COLLISION = "exists(zip_with(s, slice(s, 2, size(s)), (x, y) -> x.g = y.g AND NOT (get(v, x.i) = get(v, y.i) AND get(v, x.i + 1) = get(v, y.i + 1) AND get(v, x.i + 2) = get(v, y.i + 2))), x -> x)"
_SAME_WORDS = "(get(s, i {0} 1).a = x.a AND get(s, i {0} 1).b = x.b AND get(s, i {0} 1).c = x.c)"


def _repeated(same: str) -> str:
    """Words that repeated windows cover, of the ordered windows ``s``."""
    return _let(f"sort_array(transform(filter(s, (x, i) -> {same.format('-')} OR {same.format('+')}), x -> x.i))", "p", _COVERED)


def repeats(mixed: str = "xxhash64({0})") -> str:
    """Words that repeated windows of ``words`` cover, by a hash of three hashes."""
    of_hash = mixed.format("x, get(h, i + 1), get(h, i + 2)")
    by_hash = f"sort_array(transform(slice(h, 1, {_PLACES}), (x, i) -> struct({of_hash} AS g, i AS i)))"
    either = f"CASE WHEN coalesce({_COLLISION}, false) THEN {_let(_BY_WORDS, 's', _repeated(_SAME_WORDS))} ELSE {_repeated('get(s, i {0} 1).g = x.g')} END"
    return _let("words", "v", _let("transform(v, w -> xxhash64(w))", "h", _let(by_hash, "s", either)))


_LINES = _let(
    f"filter(split(text, '\\n'), x -> trim(BOTH {_SPACE} FROM x) <> '')", "l",
    "struct(CAST(size(l) AS BIGINT) AS n_lines, CAST(size(l) - size(array_distinct(l)) AS BIGINT) AS n_dup_lines)",
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclaims")


def measure(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to carry along and the measurements of every text."""
    words = docs.select("doc_id", *carry, F.coalesce("text", F.lit("")).alias("text")).withColumn("words", F.expr(_WORDS))
    return words.select(
        "doc_id",
        *carry,
        F.expr("CAST(size(words) AS BIGINT)").alias("n_words"),
        F.expr("aggregate(words, 0L, (n, w) -> n + length(w))").alias("word_chars"),
        F.expr("CAST(regexp_count(text, '[#*$%&|<>]') AS BIGINT)").alias("n_symbols"),
        F.expr("CAST(regexp_count(text, '!') AS BIGINT)").alias("n_exclaims"),
        F.expr(_LINES).alias("lines"),
        F.expr(repeats()).alias("n_repeat_words"),
    ).select("doc_id", *carry, "n_words", "word_chars", "n_symbols", "lines.*", "n_repeat_words", "n_exclaims")


#: Rules in the order of their bits; a rule holds for the documents that fail it.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 6 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 16 * n_words",
    "exclamations": "4 * n_exclaims > n_words",
}

#: Policies by version: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeated_words"),
    "v2": ("few_words", "repeated_words", "symbols", "duplicate_lines", "word_length", "exclamations"),
}
CURRENT = "v2"


def mask_of(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def ledger(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, measurements and failures (bit k: the k-th rule failed), and the columns to carry along."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(RULES.values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measure(docs, carry).withColumn("failures", total)


def passes(version: str, failures: Column | None = None) -> Column:
    """Whether a ledger row passes a policy."""
    failures = F.col("failures") if failures is None else failures
    return failures.bitwiseAND(F.lit(mask_of(POLICIES[version]))) == 0


def ablations(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents it fails, documents that it alone rejects, and documents
    kept without it.

    Rows are first counted by their failure bits, so at most 2 ** rules rows are looked at for each rule.
    """
    mask = mask_of(POLICIES[version])
    counts = rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask_of((r,))).alias("bit")) for r in POLICIES[version]]))
    each = counts.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
        F.bit_or("bits").alias("seen_bits"),
    )


def judged(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with base_failed (few or repeated words) and kept (the policy's verdict)."""
    base = F.col("failures").bitwiseAND(F.lit(mask_of(POLICIES["v1"]))) != 0
    return ledger(docs).select("doc_id", *MEASURES, "failures", base.alias("base_failed"), (~base & passes(version)).alias("kept"))


def passing(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """Rows of docs, all columns kept, that a policy passes.

    The verdict is a column of the row itself, so neither texts nor ids are shuffled.
    """
    names = docs.columns
    row = docs.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"))
    return ledger(row, carry=("_row",)).filter(passes(version)).select("_row.*")
