"""Personal data by bootstrapped contextual extraction, in column expressions and joins only.

Seeds are the values that the base rules find. Every mention (a seed, or another token
that looks like an identifier) stands in lexical patterns: the two words before it, and
the words on both sides. Patterns and mentions make a bipartite graph. Scores go back
and forth on it: a pattern's confidence in a kind is the mean score of the distinct
values seen in it, and a value's score is the chance that some confident pattern is
right. Patterns that stay confident and have enough seeds name as that kind the unseen
identifiers in them, in whatever form, if digits, letters and length could be that kind's.

One pass over the texts makes all mentions with their places; the rest works on them.
A row without mentions keeps one marker row, so nothing is joined back to the texts.
Candidates for discovery are tokens of 6 to 40 characters and the spelt-out forms below:
that is what an identifier is taken to look like. The words of a pattern may be of any
length (very long ones stand by their hash); a white space run of up to six counts as one.

Spans are in code points, end exclusive. Null text counts as empty; null ids stay null;
repeated rows are scanned alike; of patterns that tie in confidence the kind listed first
wins; other columns are ignored, whatever their names; no rows give no rows. Places come
from running sums over a row's gaps and hits, so a text with very many hits costs a sort,
not a square. Mentions of a hot pattern are dealt over tasks by a salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.vectors import let
from quillrank.llm.common import join_hot, whole_text
from quillrank.session import cut

#: Kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
# The same matches as the plain patterns, written so that no run is tried from each of its places.
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: What may be an identifier no base rule knows: spelt-out addresses, groups of digits, groups of hex digits between
#: colons, and tokens with a digit, an at sign, an underscore or a dot between letters.
_OF = "A-Za-z0-9@._%+/()-"
OTHER = (
    rf"(?<![{_OF}])(?:"
    r"[A-Za-z0-9._%+-]{1,64}(?:\x20?[\[({]\x20?(?i:at)\x20?[\])}]\x20?|\x20at\x20|\x20?@\x20?)[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[({]\x20?(?i:dot)\x20?[\])}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,63}){1,4}"
    r"|\+?\(?[0-9]{1,6}\)?(?:[\x20./-]{1,2}\(?[0-9]{1,6}\)?){1,7}"
    r"|(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}"
    rf"|(?=[{_OF}]{{0,39}}?(?:[0-9@_]|[A-Za-z]\.[A-Za-z]))[{_OF}]{{5,39}}[A-Za-z0-9)]"
    rf")(?![._%+/()@-]*[A-Za-z0-9])"
)
OTHER_KIND, MARKER = len(KINDS), -1
#: A pattern needs this many distinct seeds and this confidence; scores go back and forth this often.
MIN_SEEDS, MIN_CONFIDENCE, ROUNDS = 3, 0.8, 2
#: A mention may have this many digits more or fewer than the seeds of its kind, and be so many times as short or long.
DIGITS_APART, LENGTH_TIMES = 3, 4


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    each = F.transform(F.split(F.reverse(_digits(value)), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    count = F.length(_digits(value))
    return (
        F.when(kind == 0, True)
        .when(kind == 1, F.forall(parts, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255)))
        .when(kind == 2, count.between(13, 19) & luhn(value))
        .when(kind == 3, count.between(9, 15))
        .otherwise(True)
    )


def _spaced(text: Column) -> Column:
    return F.translate(text, "\t\n\x0b\f\r", "     ")


def _ending(gap: Column) -> Column:
    """The end of a gap with its last two words, whatever their length."""
    return F.substring_index(F.rtrim(_spaced(gap)), " ", -8)


def _beginning(gap: Column) -> Column:
    """The first word of a gap, whatever its length."""
    return F.substring_index(F.ltrim(_spaced(gap)), " ", 1)


def _hits(kind: int, pattern: str) -> Column:
    """Gap lengths, values and contexts of all matches of a pattern, in order."""
    body, p = F.col("_body"), F.lit(pattern)
    both = F.struct(F.regexp_extract_all(body, p, F.lit(0)).alias("v"), F.split(body, pattern, -1).alias("g"))
    cells = let(
        both,
        lambda z: F.transform(
            z["v"],
            lambda v, i: F.struct(
                F.lit(kind).alias("kind"), i.alias("i"), F.length(z["g"][i]).alias("gap"), v.alias("value"), _ending(z["g"][i]).alias("left"), _beginning(z["g"][i + 1]).alias("right")
            ),
        ),
    )
    kinds = "array<struct<kind:int,i:int,gap:int,value:string,left:string,right:string>>"
    return F.when(body.rlike(pattern), cells).otherwise(F.array().cast(kinds)).cast(kinds)


def mentions(docs: DataFrame) -> DataFrame:
    """One row per match of any pattern, and one marker (kind -1) per row of ``docs``."""
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("_body"))
    marker = F.array(F.struct(F.lit(MARKER).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit("").alias("value"), F.lit("").alias("left"), F.lit("").alias("right")))
    # Every base kind but the email needs a digit.
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,value:string,left:string,right:string>>")
    digits = F.col("_body").rlike("[0-9]")
    found = [F.when(F.contains("_body", F.lit("@")), _hits(0, PATTERNS[0])).otherwise(none)]
    found += [F.when(digits, _hits(k, PATTERNS[k])).otherwise(none) for k in (1, 2, 3)] + [_hits(OTHER_KIND, OTHER)]
    rows = base.select("rid", "doc_id", F.explode(F.concat(marker, *found)).alias("m")).select("rid", "doc_id", "m.*")
    before = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("value")
    end = F.sum(F.col("gap").cast("long") + size).over(before)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - size).where((F.col("kind") == MARKER) | _valid(F.col("kind"), F.col("value")))


def _short(word: Column) -> Column:
    return F.when(F.length(word) > 64, F.concat(F.lit("#"), F.xxhash64(word).cast("string"))).otherwise(word)


def _last_word(text: Column, n: int) -> Column:
    words = F.transform(F.filter(F.split(F.lower(text), " "), lambda w: w != ""), _short)
    return F.when(F.size(words) >= n, F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), n), " "))


def ranges(found: DataFrame) -> DataFrame:
    """Per kind the usual digits and lengths of its distinct seeds."""
    seeds = found.where(F.col("kind").between(0, OTHER_KIND - 1)).select("kind", "value").distinct()
    ends = lambda x, n: F.percentile_approx(x, [0.01, 0.99]).alias(n)
    return seeds.groupBy("kind").agg(ends(F.length(_digits(F.col("value"))), "digits"), ends(F.length("value"), "sizes"))


def fits(kind: Column, value: Column, digits: Column, sizes: Column) -> Column:
    """Whether a value could be of a kind at all: its length, letters for an address, hex groups for an ip, digits for a number."""
    n, size = F.length(_digits(value)), F.length(value)
    number = n.between(digits[0] - DIGITS_APART, digits[1] + DIGITS_APART) & ~value.rlike("[A-Za-z]")
    fair = F.when(kind == 0, value.rlike("[A-Za-z]")).when(kind == 1, value.rlike(r"^[0-9A-Fa-f.:]*[.:][0-9A-Fa-f.:]*$")).otherwise(number)
    return size.between(sizes[0] / LENGTH_TIMES, sizes[1] * LENGTH_TIMES) & fair


def edges(found: DataFrame) -> DataFrame:
    """(pattern, value, kind) for every mention; kind is null unless a base rule found the value there."""
    left = _last_word(F.col("left"), 2)
    around = F.concat(_last_word(F.col("left"), 1), F.lit(" _ "), _short(F.lower("right")))
    return (
        found.where(F.col("kind") != MARKER)
        .select("rid", "doc_id", "kind", "start", "end", "value", F.explode(F.array_compact(F.array(F.concat(F.lit("< "), left), around))).alias("pattern"))
    )


def confident_patterns(found: DataFrame, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, rounds: int = ROUNDS) -> tuple[DataFrame, int]:
    """(pattern, kind, confidence, m) after scoring the graph back and forth (m: a pattern's mentions), and all mentions."""
    graph = cut(edges(found).groupBy("pattern", "value").agg(F.min("kind").alias("kind"), F.count(F.lit(1)).alias("m")))
    total = graph.agg(F.sum("m")).first()[0] or 0
    scores = graph.where(F.col("kind") < OTHER_KIND).select("value", "kind", F.lit(1.0).alias("score")).distinct()
    seeds, sizes = scores.select("value", "kind"), graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("m"))
    links = graph.select("pattern", "value")
    patterns = None
    for k in range(rounds):
        patterns = cut(
            links.join(scores, "value").join(seeds.withColumn("seed", F.lit(1)), ["value", "kind"], "left").groupBy("pattern", "kind")
            .agg(F.sum("score").alias("s"), F.count("seed").alias("seeds")).where(F.col("seeds") >= min_seeds)
            .join(sizes, "pattern").select("pattern", "kind", (F.col("s") / F.col("n")).alias("confidence"), "m")
        )
        if k < rounds - 1:
            learned = of_pattern(links, patterns, total).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("confidence")))))).alias("score"))
            scores = learned.unionByName(seeds.withColumn("score", F.lit(1.0))).groupBy("value", "kind").agg(F.max("score").alias("score"))
    return patterns.where(F.col("confidence") >= min_confidence), total


def of_pattern(rows: DataFrame, patterns: DataFrame, total: int) -> DataFrame:
    """``rows`` with each kind and confidence of their pattern; rows of a hot pattern are dealt over tasks."""
    kinds = patterns.groupBy("pattern").agg(F.max("m").alias("m"), F.collect_list(F.struct("kind", "confidence")).alias("kinds"))
    return join_hot(rows, kinds, ["pattern"], "m", total).drop("m").withColumn("k", F.explode("kinds")).select(*rows.columns, "k.kind", "k.confidence")


def discovered(found: DataFrame, **how) -> DataFrame:
    """Unseen identifiers: (rid, doc_id, kind, start, end) of mentions that no base rule found."""
    patterns, total = confident_patterns(found, **how)
    others = edges(found).where(F.col("kind") == OTHER_KIND).drop("kind")
    named = of_pattern(others, patterns, total).join(F.broadcast(ranges(found)), "kind").where(fits(F.col("kind"), F.col("value"), F.col("digits"), F.col("sizes")))
    # A mention is of one kind, that of its most confident pattern.
    named = named.groupBy("rid", "doc_id", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    named = named.select("rid", "doc_id", "kind", "start", "end")
    known = found.where(F.col("kind").between(0, OTHER_KIND - 1)).select(F.col("rid").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"))
    return named.join(known, (F.col("rid") == F.col("r")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")), "left_anti")


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, **how) -> DataFrame:
    """Per row: doc_id, counts by kind, digest of the base spans, all spans, how many were discovered, and how many there are."""
    found = cut(mentions(docs))
    every = found.where(F.col("kind") != OTHER_KIND).select("rid", "doc_id", "kind", "start", "end", F.lit(True).alias("base")).unionByName(discovered(found, **how).withColumn("base", F.lit(False)))
    spans = lambda which: F.array_sort(F.collect_list(F.when((F.col("kind") >= 0) & which, F.struct("kind", "start", "end"))))
    count = lambda k: F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{KINDS[k]}")
    rows = every.groupBy("rid", "doc_id").agg(*[count(k) for k in range(len(KINDS))], spans(F.col("base")).alias("b"), spans(F.lit(True)).alias("a"), F.count_if(~F.col("base")).alias("n_discovered"), F.count_if(F.col("kind") >= 0).alias("n_spans"))
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_joined(F.col("b")), 256).alias("base_sha256"), _joined(F.col("a")).alias("spans"), "n_discovered", "n_spans")
