"""Secrets in texts: three patterns, and character Markov models of random strings against ordinary identifiers.

DataFrame functions only. Offsets count code points, ends are exclusive. Work is linear in the length of a text and in its
matches: places are sums by blocks, and texts are split and joined, never cut again and again from their start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, materialise

#: Pattern kinds in the order that breaks ties, each with its pattern, the group whose length counts, and
#: the least length.
KINDS = {
    "assign": (r"""((?i)password|passwd|secret|token|api_?key(?-i))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Kind of the spans that the models add, and what they look at: runs of these characters, this long at least.
ADDED, CANDIDATE, LEAST = "markov", r"[A-Za-z0-9+/_=-]{20,}", 20
#: Characters of the models; all others are one more state, as are the ends of a string.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
#: Labelled strings of each class the models are trained on at most (bounded sample).
SAMPLE = 20_000
#: Log-likelihood ratio per character above which a run is random.
MARGIN = 0.5


#: Characters of found spans are moved to a private plane, where they still stand for themselves at the same places.
PLAIN = "".join(map(chr, range(0x20, 0x7F)))
MARKED = "".join(chr(0xF0000 + ord(c)) for c in PLAIN)
ANY_MARKED = r"[\x{F0020}-\x{F007E}]"
BLOCK = 64


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def before(sizes: Column) -> Column:
    """For each element of an array of numbers the sum of all before it."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def of(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / BLOCK), F.lit(0)).cast("int"))
        return let(F.transform(blocks, lambda b: total(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))), lambda sums: by_block(v, sums))

    def by_block(v: Column, sums: Column) -> Column:
        starts = F.transform(sums, lambda x, b: total(F.slice(sums, F.lit(1), b)))
        return let(starts, lambda at: F.transform(v, lambda x, i: at[F.floor(i / BLOCK).cast("int")] + total(F.slice(v, i - i % BLOCK + 1, i % BLOCK))))

    return let(sizes, of)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start int, end int, value string>> of the leftmost non-overlapping matches of ``pattern``.

    What lies between matches comes from splitting, so starts are running sums of both lengths.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    rows = F.zip_with(found, between, lambda m, b: F.struct(m.alias("value"), F.length(b).alias("gap"), F.length(m).alias("size")))
    rows = F.filter(rows, lambda r: r["value"].isNotNull())
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, end: INT, value: STRING>>)")

    def placed(rows: Column) -> Column:
        starts = before(F.transform(rows, lambda r: r["gap"] + r["size"]))
        return F.zip_with(rows, starts, lambda r, at: F.struct((at + r["gap"]).alias("start"), (at + r["gap"] + r["size"]).alias("end"), r["value"].alias("value")))

    return F.when(text.rlike(pattern), let(rows, placed)).otherwise(empty)


def rewritten(text: Column, pattern: str, change) -> Column:
    """``text`` with ``change`` of each match in place of it."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pieces = F.zip_with(between, F.transform(found, change), lambda b, m: F.concat(b, F.coalesce(m, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def either(chars: str) -> str:
    """A class of plain ASCII ranges such as ``A-Z0-9`` with their marked characters."""
    marked = "".join(c if c == "-" and 0 < i < len(chars) - 1 else rf"\x{{{0xF0000 + ord(c):X}}}" for i, c in enumerate(chars))
    return f"[{chars}{marked}]" if not chars.endswith("-") else f"[{chars[:-1]}{marked}-]"


def mark(value: Column) -> Column:
    return F.translate(value, PLAIN, MARKED)


def unmark(value: Column) -> Column:
    return F.translate(value, MARKED, PLAIN)


def _kind(name: str, rank: int, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(name).alias("kind")))


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind the matches whose counted group is long enough."""
    pattern, _, least = KINDS["assign"]
    out = {"assign": F.filter(matches(text, pattern), lambda s: F.length(F.regexp_extract(s["value"], pattern, 2)) >= least)}
    # Maximal runs: asking for the least length at once finds the same matches and skips the short ones.
    out["access"] = matches(text, r"AKIA[A-Z0-9]{16,}")
    out["hex"] = matches(text, r"[0-9a-f]{24,}")
    return out


def base_marked(text: Column) -> Column:
    """``text`` with the characters of all base spans marked; such characters that a text has itself become U+FFFD."""
    pattern, _, least = KINDS["assign"]
    clean = F.regexp_replace(text, ANY_MARKED, "\ufffd")
    out = rewritten(clean, pattern, lambda m: F.when(F.length(F.regexp_extract(m, pattern, 2)) >= least, mark(m)).otherwise(m))
    access = "".join(either(c) for c in "AKIA") + either("A-Z0-9") + "{16,}"
    return let(let(out, lambda t: rewritten(t, access, mark)), lambda t: rewritten(t, either("0-9a-f") + "{24,}", mark))


# ---- models


def train(samples: DataFrame, sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratios of character pairs, ``STATES`` to the power of two of them, row by row.

    ``samples``: (value string, random boolean). At most ``sample`` strings of each class are used, those with the
    smallest hashes, so the result is the same in each run. Counts are smoothed by 1/2; a class without samples has
    even probabilities.
    """
    ranked = samples.where("value IS NOT NULL AND random IS NOT NULL").distinct()
    chosen = None
    for label in ("true", "false"):
        part = ranked.where(f"random = {label}").orderBy(F.xxhash64("value"), "value").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    code = f"IF(instr('{ALPHABET}', c) = 0, {STATES - 1}, instr('{ALPHABET}', c) - 1)"
    codes = chosen.where("length(value) > 1").select("random", F.expr(f"transform(split(value, ''), c -> {code})").alias("c"))
    pairs = codes.select("random", F.explode(F.expr(f"transform(sequence(0, size(c) - 2), i -> c[i] * {STATES} + c[i + 1])")).alias("pair"))
    counts = {(r.random, r.pair): r["count"] for r in pairs.groupBy("random", "pair").count().collect()}  # alphabet squared, twice
    import math

    out = []
    for a in range(STATES):
        row = {k: sum(counts.get((k, a * STATES + b), 0) for b in range(STATES)) for k in (True, False)}
        for b in range(STATES):
            p, q = ((counts.get((k, a * STATES + b), 0) + 0.5) / (row[k] + 0.5 * STATES) for k in (True, False))
            out.append(math.log(p / q))
    return out


def ratio(value: Column, model: list[float]) -> Column:
    """Sum of the pairs' log-likelihood ratios over a string."""
    table = F.split(F.lit(",".join(repr(x) for x in model)), ",").cast("array<double>")  # folded into one literal
    letters = F.lit(ALPHABET)

    def state(c: Column) -> Column:
        i = F.instr(letters, c)
        return F.when(i == 0, STATES - 1).otherwise(i - 1)

    def total(codes: Column) -> Column:
        steps = F.sequence(F.lit(1), F.greatest(F.size(codes) - 1, F.lit(1)))
        return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.get(table, F.get(codes, i - 1) * STATES + F.get(codes, i)))

    return F.when(F.length(value) > 1, let(F.transform(F.split(value, ""), state), total)).otherwise(0.0)


def labelled_samples(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(value, random): labelled by the patterns. Values the patterns find are random strings; so are digests of
    numbers in base 64, which show other alphabets than the patterns' own. Long runs of letters, and the text's words
    run together in twos and threes by ``_``, ``-`` or nothing, are ordinary identifiers."""
    spark = docs.sparkSession
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    # Words of the whole documents with the smallest hashes, a bounded number of different texts: only the hashes are
    # ranked, so no task gathers texts.
    hashes = docs.select(F.xxhash64(text).alias("o")).distinct().orderBy("o").limit(max(1, sample // 20))
    last = hashes.agg(F.max("o")).first()[0]
    some = docs.select(text.alias("t"), F.xxhash64(text).alias("o")).where(F.col("o") <= F.lit(last)).dropDuplicates(["o"])
    words = F.regexp_extract_all("t", F.lit("[A-Za-z]{2,}"), F.lit(0))
    joined = F.expr("transform(sequence(1, greatest(size(w) - 2, 1)), i -> concat_ws(CASE i % 3 WHEN 0 THEN '_' WHEN 1 THEN '-' ELSE '' END, w[i - 1], w[i], CASE WHEN i % 2 = 0 THEN w[i + 1] END))")
    plain = some.select(words.alias("w")).where("size(w) > 1").select(F.explode(joined).alias("value"))
    pattern = KINDS["assign"][0]
    found = docs.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(2))).alias("value")).where("length(value) >= 16")
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    drawn = spark.range(sample).select(F.substring(F.base64(digest), 1, 40).alias("value"))
    drawn = drawn.withColumn("value", F.when(F.xxhash64("value") % 2 == 0, F.regexp_replace("value", "[+/=]", "")).otherwise(F.col("value")))
    return plain.select("value", F.lit(False).alias("random")).unionByName(found.unionByName(drawn).select("value", F.lit(True).alias("random")))


RUN, RUN_PLAIN = either(CANDIDATE[1:-6]) + f"{{{LEAST},}}", CANDIDATE[:-5] + "+"


def is_random(value: Column, model: list[float], margin: float) -> Column:
    """Whether the models call a run random; only runs with a digit and letters, or of both cases, are looked at."""
    looks = value.rlike("[0-9]") & value.rlike("[A-Za-z]") | value.rlike("[a-z][A-Z].*[a-z][A-Z]")
    return looks & (ratio(value, model) > margin * F.length(value))


def added_spans(marked: Column, model: list[float], margin: float) -> Column:
    """array<struct<start, end>>: runs of a marked text that the models call random. Of a run that holds marked characters
    those parts beside them count that are more like random strings than like identifiers themselves."""

    def parts(s: Column) -> Column:
        beside = F.filter(matches(s["value"], RUN_PLAIN), lambda p: ratio(p["value"], model) > 0)
        beside = F.transform(beside, lambda p: F.struct((s["start"] + p["start"]).alias("start"), (s["start"] + p["end"]).alias("end")))
        return F.when(s["value"].rlike(ANY_MARKED), beside).otherwise(F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    runs = F.filter(matches(marked, RUN), lambda s: s["value"].rlike(RUN_PLAIN) & is_random(unmark(s["value"]), model, margin))
    return F.flatten(F.transform(runs, parts))


def scan(docs: DataFrame, model: list[float], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """(row, text, base, added): ``row`` is the struct of ``docs``' columns; spans are (start, rank, end, kind), in order.

    Whole texts; null is empty. ``base`` holds the patterns' spans as they are. ``added`` holds runs that the models
    call random, without what base spans cover of them. Empty table: empty result; repeated rows stay repeated.
    """
    row = F.struct(*[column(docs, c) for c in docs.columns])
    base = docs.select(row.alias("row"), F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"))
    spans = base_spans(F.col("text"))
    kinds = F.concat(*[_kind(k, i, spans[k]) for i, k in enumerate(KINDS)])
    found = base.select("row", "text", F.array_sort(kinds).alias("base"))
    marked = F.when(F.size("base") > 0, base_marked(F.col("text"))).otherwise(F.regexp_replace("text", ANY_MARKED, "\ufffd"))
    return found.select("row", "text", "base", _kind(ADDED, len(KINDS), added_spans(marked, model, margin)).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: list[float], text_col: str = "text", mark_with: str = "[SECRET]", margin: float = MARGIN) -> DataFrame:
    """``docs`` with every span in its texts replaced by ``mark_with``, columns as they were; other texts stay untouched.

    Spans that overlap or touch are one. Null texts stay null. A column n_chars, if there is one, follows the text. Empty
    table: empty result; repeated rows stay repeated, and other columns may have any names.
    """
    row = F.struct(*[column(docs, c) for c in docs.columns])
    base = docs.select(row.alias("row"), base_marked(F.coalesce(column(docs, text_col).cast("string"), F.lit(""))).alias("marked"))

    def change(run: Column) -> Column:
        inside = F.when(run.rlike(ANY_MARKED), rewritten(run, RUN_PLAIN, lambda p: F.when(ratio(p, model) > 0, mark(p)).otherwise(p))).otherwise(mark(run))
        return F.when(run.rlike(RUN_PLAIN) & is_random(unmark(run), model, margin), inside).otherwise(run)

    found = base.select("row", rewritten(F.col("marked"), RUN, change).alias("marked"))
    old, hit = F.col("row").getField(text_col), F.col("marked").rlike(ANY_MARKED)
    clean = F.regexp_replace("marked", ANY_MARKED + "+", mark_with)
    out = found.select("row", hit.alias("hit"), F.when(hit, clean).otherwise(old).alias("clean"))
    fields = {c: F.col("row").getField(c) for c in docs.columns}
    fields[text_col] = F.col("clean")
    if "n_chars" in fields:
        fields["n_chars"] = F.when(F.col("hit"), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(fields["n_chars"])
    return out.select(*[v.alias(k) for k, v in fields.items()])
