"""Secret scan: fixed patterns, and a battery of randomness tests on other long tokens with control of false discoveries by length.

*Base patterns* (password-like assignments, access keys, long hexadecimal numbers) are always reported.

*Random tokens.* Runs of 16 or more of ``A-Z a-z 0-9 + / _ = -`` are tested, and so are their parts of that length
between ``=``, between ``=`` and ``/``, and so on for ``_`` and ``-``: a name or path before a value does not hide it. Dashes between groups of hexadecimal digits (as in a UUID), or of
digits and letters of one case where two groups or more mix both, are not part of the token's alphabet. Of discoveries in one run that overlap, the one with the highest level stays, the longest of equal ones. The smallest alphabet that holds all of its characters
(decimal, hexadecimal, lower or upper case without or with digits, letters, base 62, base 64) is inferred for each of them, and three tests ask whether the token could be a uniform draw from it:
chi-squared of its character groups, the number of runs (above and below the middle of the alphabet), and the correlation of neighbouring
characters. Under the opposite hypothesis, text, the likelihood ratio against letter frequencies is an e-value: the chance that text reaches it is at most its inverse. Tokens without a lower-case
letter are held against text in capitals. Runs of digits are rare in text, so that long numbers which look like uniform draws (such as card numbers) are discoveries.
A token that passes all three tests at ``FIT`` is a discovery if its p-value is within the Benjamini-Hochberg bound at ``FALSE_RATE`` among all tokens of its
length class in the corpus, so that many short tokens cannot use up the allowance of long ones.

Levels of p are hundredths of a decimal place; only counts per (length class, level) are gathered, a few thousand rows whatever the corpus.

Positions are code points, ends exclusive. Found spans that overlap a base span are left out. All of it is column expressions.

Cases: null and empty texts have no spans; repeated rows are scanned one by one; an empty table gives an empty result;
other columns are not looked at; very long texts are scanned whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietwire.llm.tables import documents_of, written

#: The base patterns, their kinds in order, and the least number of characters.
ASSIGN = (r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
#: Parts of such runs: at each separator in order the characters that remain; a part is new if that separator stands before or after it.
PARTS = tuple(rf"(?<={mark})[{rest}]{{16,}}+|(?<![{rest}])[{rest}]{{16,}}+(?={mark})"
              for mark, rest in (("=", "A-Za-z0-9+/_-"), ("/", "A-Za-z0-9+_-"), ("_", "A-Za-z0-9+-"), ("-", "A-Za-z0-9+")))
FIT = 0.001
FALSE_RATE = 0.01
#: Length classes: from so many characters on.
CLASSES = (16, 20, 24, 32, 48)
#: Relative frequencies of letters in running text, in per mille (rounded, English; other languages that use Latin letters are close enough for a bound).
LETTERS = {"e": 127, "t": 91, "a": 82, "o": 75, "i": 70, "n": 67, "s": 63, "h": 61, "r": 60, "d": 43, "l": 40, "c": 28, "u": 28, "m": 24, "w": 24, "f": 22,
           "g": 20, "y": 20, "p": 19, "b": 15, "v": 10, "k": 8, "j": 2, "x": 2, "q": 1, "z": 1}
KINDS = ("assign", "access", "hex", "random")


def matches(text: Column, pattern: str, kind: int) -> Column:
    """The leftmost non-overlapping matches as (kind, i, gap, size, value); ``gap`` is the length of what stands between a match and the one before."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    paired = F.zip_with(values, F.slice(between, 1, F.size(values)), lambda v, b: F.struct(v.alias("value"), F.char_length(b).alias("gap")))
    listed = F.transform(paired, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), m["gap"].alias("gap"), F.char_length(m["value"]).alias("size"), m["value"].alias("value")))
    return F.when(text.rlike(pattern), listed).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,value:string>>"))


def placed_matches(docs: DataFrame) -> DataFrame:
    """One row for each match that counts, and one with null ``kind`` for each document: uid, doc_id, kind, start, end, value.

    The running position needs the matches of one document and kind together, nothing else.
    """
    patterns = (ASSIGN, rf"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", rf"[0-9a-f]{{{LEAST['hex']},}}", TOKEN, *PARTS)
    found = F.concat(*[matches(F.col("text"), p, k) for k, p in enumerate(patterns)])
    none = F.array(F.struct(F.lit(None).cast("int").alias("kind"), F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("gap"),
                            F.lit(None).cast("int").alias("size"), F.lit(None).cast("string").alias("value")))
    held = written(documents_of(docs).select(F.monotonically_increasing_id().alias("uid"), "doc_id", found.alias("found")), "matches")
    rows = held.select("uid", "doc_id", F.inline(F.concat(none, "found")))
    so_far = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    rows = rows.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.col("size"))
    long_enough = F.char_length(F.regexp_extract("value", ASSIGN, 1)) >= LEAST["assign"]
    testable = F.col("value").rlike("[A-Za-z0-9]") & (F.char_length(F.regexp_replace("value", "=+$", "")) >= CLASSES[0])
    counts = F.col("kind").isNull() | F.col("kind").isin(1, 2) | ((F.col("kind") == 0) & long_enough) | ((F.col("kind") >= 3) & testable)
    return rows.where(counts).select("uid", "doc_id", F.when(F.col("kind") > 3, 3).otherwise(F.col("kind")).alias("kind"), "start", "end", F.when(F.col("kind") >= 3, F.col("value")).alias("value"))


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def alphabet(token: Column) -> Column:
    """The smallest alphabet that holds a token (``-`` and ``_`` read as ``+`` and ``/``)."""
    return (F.when(token.rlike("^[0-9]+$"), _DIGITS).when(token.rlike("^[0-9a-f]+$"), _DIGITS + "abcdef").when(token.rlike("^[0-9A-F]+$"), _DIGITS + "ABCDEF")
            .when(token.rlike("^[a-z]+$"), _LOWER).when(token.rlike("^[A-Z]+$"), _UPPER).when(token.rlike("^[A-Za-z]+$"), _UPPER + _LOWER)
            .when(token.rlike("^[0-9a-z]+$"), _DIGITS + _LOWER).when(token.rlike("^[0-9A-Z]+$"), _DIGITS + _UPPER)
            .when(token.rlike("^[0-9A-Za-z]+$"), _DIGITS + _UPPER + _LOWER).otherwise(_DIGITS + _UPPER + _LOWER + "+/"))


def two_sided(z: Column) -> Column:
    """The normal probability beyond |z|, by a logistic curve (within 0.0002)."""
    x = F.abs(z)
    return 2 / (1 + F.exp(F.lit(1.5976) * x + F.lit(0.070566) * x * x * x))


def _text_odds() -> Column:
    """Character -> natural logarithm of its probability in text-like tokens: 85 % lower case, 8 % upper case, 5 % digits, 2 % marks."""
    total = sum(LETTERS.values())
    odds = {c: 0.85 * n / total for c, n in LETTERS.items()} | {c.upper(): 0.08 * n / total for c, n in LETTERS.items()}
    odds |= {d: 0.005 for d in _DIGITS} | {m: 0.01 for m in "+/"}
    return F.create_map(*[F.lit(x) for c, v in odds.items() for x in (c, math.log(v))])


def tested(tokens: DataFrame) -> DataFrame:
    """``tokens`` (value) with length_class, level (hundredths of a decimal place of the p-value against text) and fits (all three tests)."""
    bare = F.regexp_replace("value", "=+$", "")
    both = F.size(F.filter(F.split(bare, "-"), lambda g: g.rlike("[0-9][A-Za-z]|[A-Za-z][0-9]")))
    grouped = bare.rlike("[A-Za-z]") & (bare.rlike("^(?:[0-9a-f]+(?:-[0-9a-f]+)+|[0-9A-F]+(?:-[0-9A-F]+)+)$")
                                        | ((both >= 2) & bare.rlike("^(?:[0-9a-z]+(?:-[0-9a-z]+)+|[0-9A-Z]+(?:-[0-9A-Z]+)+)$")))
    grouped = grouped & (F.char_length(F.translate(bare, "-", "")) >= CLASSES[0])
    plain = F.when(grouped, F.translate(bare, "-", "")).otherwise(F.translate(bare, "-_=", "+/+"))
    rows = tokens.withColumn("_token", plain).withColumn("_alphabet", alphabet(F.col("_token")))
    rows = rows.withColumn("_signs", F.slice(F.split("_token", "", -1), 1, F.char_length("_token")))
    rows = rows.withColumn("_codes", F.transform("_signs", lambda c: F.position(c, F.col("_alphabet")).cast("double") - 1))
    n, size = F.char_length("_token").cast("double"), F.char_length("_alphabet").cast("double")
    total = lambda array: F.aggregate(array, F.lit(0.0), lambda s, x: s + x)
    # chi-squared over five groups of neighbouring characters; with four degrees of freedom the tail has a closed form
    edge = lambda g: F.ceil(F.lit(g) * size / 5).cast("double")
    chi = F.lit(0.0)
    within = lambda g: lambda c: (c >= edge(g)) & (c < edge(g + 1))
    for g in range(5):
        seen = F.size(F.filter("_codes", within(g))).cast("double")
        expected = n * (edge(g + 1) - edge(g)) / size
        chi = chi + (seen - expected) * (seen - expected) / expected
    uniform = F.exp(-chi / 2) * (1 + chi / 2)
    # runs above and below the middle
    pairs = F.transform(F.sequence(F.lit(1), F.size("_codes") - 1), lambda i: F.struct(F.col("_codes")[i - 1].alias("a"), F.col("_codes")[i].alias("b")))
    high = F.size(F.filter("_codes", lambda c: c >= size / 2)).cast("double")
    runs = F.size(F.filter(pairs, lambda q: (q["a"] >= size / 2) != (q["b"] >= size / 2))).cast("double") + 1
    product = 2 * high * (n - high)
    spread = F.sqrt(F.greatest(product * (product - n) / (n * n * (n - 1)), F.lit(1e-9)))
    # correlation of neighbours
    middle = (size - 1) / 2
    variance = F.greatest(total(F.transform("_codes", lambda c: (c - middle) * (c - middle))), F.lit(1e-9))
    serial = total(F.transform(pairs, lambda q: (q["a"] - middle) * (q["b"] - middle))) / variance
    fits = (uniform >= FIT) & (two_sided((runs - product / n - 1) / spread) >= FIT) & (two_sided(serial * F.sqrt(n)) >= FIT)
    odds = _text_odds()
    # text may be in capitals throughout
    letters = F.slice(F.split(F.when(F.col("_token").rlike("[a-z]"), F.col("_token")).otherwise(F.lower("_token")), "", -1), 1, F.char_length("_token"))
    ratio = total(F.transform(letters, lambda c: -F.log(size) - odds[c]))  # of uniform against text, in natural logarithms
    level = F.least(F.lit(9999), F.greatest(F.lit(0), F.floor(ratio * (100 / math.log(10))))).cast("int")
    classes = F.lit(CLASSES[0])
    for c in CLASSES[1:]:
        classes = F.when(n >= c, c).otherwise(classes)
    return (rows.withColumn("length_class", classes).withColumn("level", level).withColumn("fits", F.coalesce(fits, F.lit(False)))
            .drop("_token", "_alphabet", "_signs", "_codes"))


def level_bounds(levels: DataFrame, rate: float = FALSE_RATE) -> DataFrame:
    """(length_class, bound): the lowest level that the Benjamini-Hochberg rule accepts; ``levels`` is (length_class, level, n)."""
    down = Window.partitionBy("length_class").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = levels.withColumn("rank", F.sum("n").over(down)).withColumn("all", F.sum("n").over(Window.partitionBy("length_class")))
    accepted = F.pow(F.lit(10.0), -F.col("level") / 100) * F.col("all") <= rate * F.col("rank")
    return ranked.where(accepted).groupBy("length_class").agg(F.min("level").alias("bound"))


def apart(found: DataFrame) -> DataFrame:
    """The rows (uid, doc_id, kind, start, end, level) that remain if of those that overlap the one with the highest level, then the longest, is taken first."""
    order = Window.partitionBy("uid").orderBy("start", F.desc("end"))
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    heads = found.withColumn("_head", F.when(F.coalesce(reached <= F.col("start"), F.lit(True)), F.col("start")))
    runs = heads.withColumn("_run", F.max("_head").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    span = F.struct("level", (F.col("end") - F.col("start")).alias("size"), "start", "end")
    listed = runs.groupBy("uid", "_run").agg(F.first("doc_id").alias("doc_id"), F.first("kind").alias("kind"), F.sort_array(F.collect_list(span), False).alias("_spans"))
    free = lambda taken, s: ~F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))
    taken = F.aggregate("_spans", F.slice("_spans", 1, 0), lambda taken, s: F.when(free(taken, s), F.concat(taken, F.array(s))).otherwise(taken))
    return listed.select("uid", "doc_id", "kind", F.inline(taken)).select("uid", "doc_id", "kind", "start", "end", "level")


def secret_spans(docs: DataFrame, rate: float = FALSE_RATE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    rows = placed_matches(docs)
    judged = written(tested(rows.where("kind = 3")).unionByName(rows.where("kind is null or kind < 3"), allowMissingColumns=True).drop("value"), "tokens")
    bounds = level_bounds(judged.where("kind = 3").groupBy("length_class", "level").agg(F.count("*").alias("n")), rate)
    known = judged.join(F.broadcast(bounds), "length_class", "left")  # one row for each of CLASSES
    known = known.where("kind is null or kind < 3 or (fits and level >= bound)")
    # a random token goes if a base span overlaps it: the furthest end of those that start before, or the first that starts inside
    base = F.col("kind") < 3
    order = Window.partitionBy("uid").orderBy(F.coalesce("start", F.lit(-1)), "kind", "end")
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    kept = known.withColumn("_before", before).withColumn("_after", after).where(
        F.col("kind").isNull() | base | (F.coalesce(F.col("_before") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("_after") >= F.col("end"), F.lit(True))))
    kept = written(kept.select("uid", "doc_id", "kind", "start", "end", "level"), "discoveries")
    kept = kept.where("kind is null or kind < 3").unionByName(apart(kept.where("kind = 3")))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    span = F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("said"))
    joined = lambda flag: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(flag, span))), lambda s: s["said"]), ",")
    count = lambda k: F.count_if(F.col("kind") == k)
    return kept.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("kind").isNotNull()).alias("spans"), count(3).alias("n_random")).drop("uid")
