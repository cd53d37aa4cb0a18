"""Secrets in text: fixed patterns, and tokens that look random, by column functions only.

Long tokens are tested against randomness under the alphabet their characters suggest:
chi-squared of the characters and of their classes (upper case, lower case, others), runs
above and below the middle of the alphabet, and correlation of neighbouring characters.
The tests combine to one p-value of the token being random.

What is ordinary is not known in advance, so every token meets ``DECOYS`` decoys of its own
length and kind: names built from ordinary words, those that identifiers of the corpus
repeat and a fixed list, in the ways in which names are built. The share of decoys at or
above a p-value estimates how many of the tokens there are ordinary. Per band of lengths,
tokens of letters only apart, the lowest p-value is sought at which, and above which, that
share of all that is reported is ``FALSE_SHARE`` at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barograph.llm.common import digest, stored
from barograph.llm.spans import FOUND, SPANS, count_of, find, joined, of_kind

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Shorter tokens hold too little for the tests and are not looked at.
LEAST = 20
TOKEN = rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"
KINDS = ("assign", "access", "hex", "random")
FALSE_SHARE = 0.05
#: Decoys of a token: one token that no decoy reaches is reported.
DECOYS = 20
#: Words of decoys that come from the corpus: letters of them, uses, and how many there are at most.
PIECE = r"[A-Z]?[a-z]{2,11}"
USES = 3
PIECES = 2048
BAND = 8
BANDS = 16
#: Bins of p-values per power of ten, and in all.
FINE = 40
BINS = 10 * FINE
#: Words of ordinary identifiers.
COMMON = (
    "access account action address admin alert archive article backup base batch block board buffer build cache "
    "calendar category center change channel chapter check client cluster code collection column command comment common "
    "config connection content context control count country create customer daily data database date default delete "
    "detail device directory document download driver entry error event example export factory feature field file filter "
    "final folder format function gallery general global group handler header history home image import index info input "
    "install instance interface item job journal key language layer level library limit line link list load local log "
    "main manager map market master member message method mobile model module month name network news note number object "
    "offer option order output package page parser part path payment photo plan point policy post price process product "
    "profile program project public query queue record region release report request resource response result review role "
    "root rule sample schema search section select server service session setting source staging start state status "
    "storage store stream string style summary support system table target task temp test text theme time title topic "
    "total tracking type update upload user value vector version video view web weekly window worker writer"
)
#: Alphabets of encodings, in the order in which they are tried.
DECIMAL = "0123456789"
HEX_LOWER = "0123456789abcdef"
HEX_UPPER = "0123456789ABCDEF"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each fixed kind; the cheap test in front spares texts without the pattern."""
    none = F.array().cast(SPANS)
    assign = F.filter(find(text, ASSIGN, 2), lambda x: F.length(x["part"]) >= 6)
    return {
        "assign": F.when(text.rlike("[:=]"), of_kind(assign, "assign", 0)).otherwise(none),
        "access": F.when(text.contains("AKIA"), of_kind(find(text, ACCESS), "access", 1)).otherwise(none),
        "hex": F.when(text.rlike(HEX), of_kind(find(text, HEX), "hex", 2)).otherwise(none),
    }


def _alphabet(token: Column) -> Column:
    return (
        F.when(token.rlike("^[0-9]+$"), DECIMAL)
        .when(token.rlike("^[0-9a-f]+$"), HEX_LOWER)
        .when(token.rlike("^[0-9A-F]+$"), HEX_UPPER)
        .when(token.rlike("^[a-z]+$"), LOWER)
        .when(token.rlike("^[A-Z]+$"), UPPER)
        .when(token.rlike("^[A-Z2-7]+$"), BASE32)
        .when(token.rlike("^[0-9a-z]+$"), BASE36)
        .when(token.rlike("^[A-Za-z]+$"), UPPER + LOWER)
        .otherwise(BASE64)
    )


def _in_class(column: str, kind: str) -> Column:
    """Characters of ``column`` of a class: upper, lower or other."""
    letters = {"upper": UPPER, "lower": LOWER}
    if kind in letters:
        return (F.length(column) - F.length(F.translate(column, letters[kind], ""))).cast("double")
    return F.length(F.translate(column, UPPER + LOWER, "")).cast("double")


def _normal(z: Column) -> Column:
    """Distribution function of the normal law, within 0.0002."""
    return 1 / (1 + F.exp(-1.5976 * z - 0.070566 * z * z * z))


def randomness(tokens: DataFrame) -> DataFrame:
    """Adds ``p_random``, the combined p-value of the tests, to rows with ``token``."""
    bare = F.regexp_replace(F.translate("token", "-_", "+/"), "=+$", "")
    coded = tokens.withColumn("_bare", bare).withColumn("_alphabet", _alphabet(F.col("_bare")))
    values = F.transform(F.split("_bare", ""), lambda c: (F.instr(F.col("_alphabet"), c) - 1).cast("double"))
    coded = coded.withColumn("_v", F.filter(values, lambda x: x >= 0)).withColumn("_k", F.length("_alphabet").cast("double"))
    v, k = F.col("_v"), F.col("_k")
    zero = F.lit(0.0)
    sums = coded.select(
        "*",
        F.size("_v").cast("double").alias("_n"),
        F.aggregate(F.array_distinct(v), zero, lambda a, c: a + F.pow(F.size(F.filter(v, lambda x: x == c)).cast("double"), F.lit(2.0))).alias("_squares"),
        F.aggregate(v, zero, lambda a, x: a + x).alias("_sum"),
        F.size(F.filter(v, lambda x: x * 2 >= k)).cast("double").alias("_high"),
        F.zip_with(v, F.slice(v, 2, F.size(v)), lambda x, y: F.struct(x.alias("x"), y.alias("y"))).alias("_pairs"),
    )
    n, high, mean = F.col("_n"), F.col("_high"), F.col("_sum") / F.col("_n")
    sums = sums.withColumn("_mean", mean)
    pairs = F.filter("_pairs", lambda p: p["y"].isNotNull())
    measured = sums.select(
        "*",
        F.aggregate(pairs, F.lit(1.0), lambda a, p: a + ((p["x"] * 2 >= k) != (p["y"] * 2 >= k)).cast("double")).alias("_runs"),
        F.aggregate(pairs, zero, lambda a, p: a + (p["x"] - F.col("_mean")) * (p["y"] - F.col("_mean"))).alias("_cross"),
        F.aggregate(v, zero, lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))).alias("_spread"),
    )

    def to_normal(chi: Column, df: Column) -> Column:
        """A chi-squared value, brought to a normal one by its cube root."""
        return (F.pow(F.greatest(chi, zero) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))

    z_chi = to_normal(k / n * F.col("_squares") - n, k - 1)
    # Classes that the alphabet has; with a single one there is nothing to test.
    classes = [(_in_class("_bare", c), _in_class("_alphabet", c) / k * n) for c in ("upper", "lower", "other")]
    own = sum(((expected > 0).cast("double") for _, expected in classes), zero)
    unequal = sum((F.when(expected > 0, (found - expected) * (found - expected) / expected).otherwise(zero) for found, expected in classes), zero)
    z_class = F.when(own > 1, to_normal(unequal, F.greatest(own - 1, F.lit(1.0)))).otherwise(zero)
    expected = 2 * high * (n - high) / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    z_runs = F.when(variance > 0, (F.col("_runs") - expected) / F.sqrt(variance)).otherwise(F.lit(9.0))
    z_serial = F.when(F.col("_spread") > 0, F.col("_cross") / F.col("_spread") * F.sqrt(n)).otherwise(F.lit(9.0))
    q = F.pow(F.greatest(z_chi, zero), F.lit(2.0)) + F.pow(F.greatest(z_class, zero), F.lit(2.0)) + z_runs * z_runs + z_serial * z_serial
    z = to_normal(q, F.when(own > 1, 4.0).otherwise(3.0))
    return measured.select(*tokens.columns, (1 - _normal(z)).alias("p_random"))


def _words(tokens: DataFrame) -> list[str]:
    """Words of decoys: the fixed ones, and those that many distinct tokens have; at most ``PIECES`` more."""
    pieces = tokens.select("token").distinct().select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("token", F.lit(PIECE), 0), F.lower))).alias("word"))
    often = pieces.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= USES)
    return [*COMMON.split(), *(r["word"] for r in often.orderBy(F.desc("n"), "word").limit(PIECES).collect())]


def decoys(tokens: DataFrame, words: list[str], each: int = DECOYS) -> DataFrame:
    """``(token)``: for every token ``each`` names of ordinary words, as long as it; of letters alone if it is.

    Which words, and how they are joined, follows from hashes of the token.
    """
    listed = F.array(*[F.lit(w) for w in words])
    number = F.explode(F.sequence(F.lit(1), F.lit(each))).alias("_i")
    base = tokens.select("token", listed.alias("_words"), number)
    length, letters = F.length("token"), F.col("token").rlike("^[A-Za-z]+$")

    def draw(*parts, of: int) -> Column:
        return F.pmod(F.xxhash64("token", "_i", *parts), F.lit(of))

    # Words have three letters or more.
    chosen = F.transform(
        F.sequence(F.lit(1), F.ceil(length / 3).cast("int")), lambda j: F.element_at("_words", (draw(j, of=len(words)) + 1).cast("int"))
    )
    named = base.withColumn("_chosen", chosen).withColumn("_style", draw(F.lit("style"), of=6))
    c, style = F.col("_chosen"), F.col("_style")
    camel = F.array_join(F.transform(c, F.initcap), "")
    plain = F.array_join(c, "")
    day = F.concat_ws("-", draw(F.lit("y"), of=30) + 1996, F.lpad(draw(F.lit("m"), of=12) + 1, 2, "0"), F.lpad(draw(F.lit("d"), of=28) + 1, 2, "0"))
    alone = F.when(F.col("token").rlike("^[a-z]+$"), plain).when(F.col("token").rlike("^[A-Z]+$"), F.upper(plain)).otherwise(camel)
    joined_by = F.when(style == 0, F.array_join(c, "_")).when(style == 1, F.array_join(c, "-")).when(style == 2, F.array_join(c, "/")).when(style == 3, camel)
    # Dates and numbers stand behind the first words.
    dated = F.concat_ws("_", F.array_join(F.slice(c, 1, 1), "_"), F.when(style == 4, day).otherwise(F.replace(day, F.lit("-"), F.lit(""))), F.array_join(F.slice(c, 2, F.size(c)), "_"))
    whole = F.when(letters, alone).otherwise(F.coalesce(joined_by, dated))
    return named.select(F.substring(whole, F.lit(1), length).alias("token"))


def _placed(tested: DataFrame) -> DataFrame:
    """Adds ``_band``, ``_letters`` and ``_bin``: where a token, or a decoy, is counted."""
    return tested.select(
        "*",
        F.least(F.floor(F.length("token") / BAND), F.lit(BANDS - 1)).cast("int").alias("_band"),
        F.col("token").rlike("^[A-Za-z]+$").alias("_letters"),
        # Bins of a logarithmic scale: the least p-values are all alike.
        F.greatest(F.floor(FINE * F.log10(F.col("p_random") + 1e-10)) + BINS, F.lit(0)).cast("int").alias("_bin"),
    )


def random_tokens(tokens: DataFrame) -> DataFrame:
    """The rows with ``token`` that are reported as random, with their ``p_random``."""
    tested = _placed(randomness(tokens))
    null = _placed(randomness(decoys(tokens, _words(tokens))))
    key = ["_band", "_letters", "_bin"]
    # At most 2 * BANDS * (BINS + 1) rows from here on, whatever the input.
    counts = (
        tested.select(*key, F.lit(1).alias("own"), F.lit(0).alias("decoy"))
        .union(null.select(*key, F.lit(0), F.lit(1)))
        .groupBy(*key)
        .agg(F.sum("own").alias("own"), F.sum("decoy").alias("decoy"))
    )
    above = Window.partitionBy("_band", "_letters").orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = F.sum("decoy").over(above) + 1 <= FALSE_SHARE * DECOYS * F.sum("own").over(above)
    cuts = counts.select(*key, few.alias("_kept")).groupBy("_band", "_letters").agg(F.min(F.when(F.col("_kept"), F.col("_bin"))).alias("_cut"))
    kept = tested.join(F.broadcast(cuts), ["_band", "_letters"]).filter("_bin >= _cut")
    return kept.select(*tokens.columns, "p_random")


def find_secrets(docs: DataFrame) -> DataFrame:
    """Adds ``secrets``, an array of ``(s, o, e, kind)`` by start, to ``doc_id`` and ``text``.

    Places are code points, ends exclusive. Kinds: ``assign``, ``access`` and
    ``hex`` by pattern, ``random`` by the tests (tokens of ``LEAST`` characters or more
    that touch no other span).
    Null and empty texts have no spans. Repeated rows each have their spans. Other columns
    are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = base_spans(text)
    base = F.concat(*kinds.values())
    local = docs.select("doc_id", base.alias("base"), F.when(text.rlike(TOKEN), find(text, TOKEN)).otherwise(F.array().cast(FOUND)).alias("tokens"))
    local = stored(local.select(F.monotonically_increasing_id().alias("row"), "*"), "secrets")
    free = F.filter("tokens", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    tokens = local.select("row", F.explode(free).alias("x")).select("row", "x.s", "x.e", F.col("x.hit").alias("token"))
    one = F.struct("s", F.lit(3).alias("o"), "e", F.lit("random").alias("kind"))
    more = random_tokens(tokens).groupBy("row").agg(F.collect_list(one).alias("more"))
    out = local.join(more, "row", "left")
    return out.select("doc_id", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPANS)))).alias("secrets"))


def query(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs.select("doc_id", "text"))
    base = F.filter("secrets", lambda x: x["o"] < 3)
    counts = [count_of("secrets", kind).alias(f"n_{kind}") for kind in KINDS[:3]]
    return found.select("doc_id", *counts, digest(joined(base)).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
