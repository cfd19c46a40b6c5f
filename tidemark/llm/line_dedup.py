"""Line dedup as an exact set-similarity join over lines.

A line is the set of its words (what stands between spaces). Lines are alike when their Jaccard similarity reaches
``percent`` / 100; a line that is like an earlier one (by document id, then line number) is removed.

1. The words of all lines are counted, in a table of hash buckets of fixed size, which gives every word a rarity.
   The words of a line are ordered by rarity, then by hash: one order for all lines, so that any two alike lines
   share a word among the first few of both (*prefix filter*).
2. Lines with the same words are one class, with its first occurrence. Lines of few words can be like lines with the
   same words only, so their classes are all there is to find.
3. Of the others, classes that share a prefix word are candidates where lengths (*length filter*) and positions in the
   order (*positional filter*) allow the threshold, and a bitmap that each word toggles differs in few enough bits.
   The classes of a word meet where its few classes are; a word with many has all of them compared with the earliest
   first, then those that found no match with the rest. A group of thousands of alike lines costs one comparison each.
4. Candidates are verified on the whole sets, for each line its earliest candidate of another document first, and all
   others for those that it leaves open. Their texts are fetched with one join; a filter of fixed size over document
   ids spares most texts that shuffle.

Words are 64-bit keys: 6 bits of rarity and 58 bits of hash. Built-in functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Scratch, fresh, id_bits, maybe_in, read

#: Buckets of the table of word counts, a power of two: one byte each.
RARITY_BUCKETS = 1 << 20
#: Classes of one word that are compared with each other at once; larger groups are compared with their first before.
GROUP = 64
_NONE = (1 << 63) - 1
#: Different words from which a line counts in the share that a document lost to others: stock lines tell nothing of it.
TELLING = 5
#: Lines without it are blank and stay.
_WORD = "[^ \\t\\n\\x0B\\f\\r]"


def _rarity(docs: DataFrame) -> DataFrame:
    """One row with an array: for each bucket of words, the binary logarithm of how often they occur."""
    word = F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ", -1)).alias("w")
    counts = docs.select(word).groupBy(F.xxhash64("w").bitwiseAND(F.lit(RARITY_BUCKETS - 1)).alias("b")).agg(F.count("*").alias("n"))
    rank = F.least(F.lit(63), F.floor(F.log2("n"))).cast("tinyint")
    cells = counts.select("b", rank.alias("r"))
    spark = docs.sparkSession
    every = spark.range(RARITY_BUCKETS).select(F.col("id").alias("b")).join(cells, "b", "left").select("b", F.coalesce("r", F.lit(0).cast("tinyint")).alias("r"))
    parts = every.groupBy(F.expr("b div 1024").alias("p")).agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "r"))), lambda x: x["r"]).alias("r"))
    return parts.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("p", "r"))), lambda x: x["r"])).alias("all"))


def _hashes(line: Column) -> Column:
    return F.transform(F.split(line, " ", -1), lambda w: F.xxhash64(w))


def _ordered(df: DataFrame, line: str, rarity: DataFrame, name: str) -> DataFrame:
    """Adds the sorted keys of the distinct words. The scalar is read once, so that the optimiser puts it in place."""
    df = df.withColumn("__rarity", rarity.scalar())

    def key(h: Column) -> Column:
        r = F.get(F.col("__rarity"), h.bitwiseAND(F.lit(RARITY_BUCKETS - 1)).cast("int")).cast("long")
        return F.shiftleft(r, 57).bitwiseOR(F.shiftrightunsigned(h, 7))

    return df.withColumn(name, F.sort_array(F.array_distinct(F.transform(_hashes(F.col(line)), key)))).drop("__rarity")


def find_repeated_lines(docs: DataFrame, scratch: Scratch, percent: int = 90, min_words: int = 1) -> DataFrame:
    """Removed lines of docs (did long, th int, text): (did, th, line, elsewhere), elsewhere: like another document's line."""
    rarity = scratch.cut(_rarity(docs))
    lines = docs.select("did", "th", F.posexplode(F.split("text", "\n", -1)).alias("line", "words"))
    # fewer bytes than that cannot be enough words
    lines = lines.filter((F.octet_length("words") >= 2 * min_words - 2) & F.col("words").rlike(_WORD))
    lines = _ordered(lines, "words", rarity, "k")
    n = F.size("k")
    prefix = F.slice("k", F.lit(1), n - F.ceil(n * percent / 100).cast("int") + 1)
    # an occurrence is two longs: the id, then the hash of the text and the number of the line
    sub = F.shiftleft(F.col("th").cast("long"), 32) + F.col("line")
    # each word toggles a bit: two lines differ in no more bits than they differ in words
    sketch = F.aggregate("k", F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))))
    # n words and n + 1 words can reach the threshold from this n on
    several = -(-percent // (100 - percent)) if percent < 100 else 1 << 30
    lines = lines.select("did", sub.alias("sub"), n.alias("n"), F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), prefix).alias("h2"), sketch.alias("sk"), F.when(n >= several, prefix).alias("prefix"))
    lines = scratch.cut(lines).filter(F.col("n") >= min_words)  # on the table: before it, the optimiser would compute the keys twice
    classes = lines.groupBy("h1", "h2").agg(F.min(F.struct("did", "sub", "n", "sk", "prefix")).alias("x"), F.count("*").alias("size"))
    classes = scratch.cut(classes.select("h1", "h2", "size", "x.did", "x.sub", "x.n", "x.sk", "x.prefix"))
    scratch.sweep()
    rows = classes.filter("prefix is not null").select("did", "sub", "n", "sk", F.posexplode("prefix").alias("pos", "w"))
    rows = rows.select("w", "did", "sub", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).alias("np"), "sk")
    # how many classes a word has: counted with partial sums, so that rows meet by word once, in joins that split
    shared = scratch.cut(rows.groupBy("w").agg(F.count("*").alias("many")).filter("many > 1"))

    def may(a: str, b: str, s: str, t: str) -> Column:
        n1, p1, n2, p2 = f"({a} >> 32)", f"({a} & 4294967295)", f"({b} >> 32)", f"({b} & 4294967295)"
        most = f"(1 + least({n1} - {p1} - 1, {n2} - {p2} - 1))"
        # twice the overlap is at most the sizes less the bits that differ
        return F.expr(f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2}) and {most} * {100 + percent} >= {percent} * ({n1} + {n2}) and ({n1} + {n2} - bit_count({s} ^ {t})) * {100 + percent} >= 2 * {percent} * ({n1} + {n2})")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (ad, ax earlier, bd, bx later) those that are alike."""
        pairs = scratch.cut(pairs.distinct())
        wanted = pairs.selectExpr("ad as did", "ax as x").union(pairs.selectExpr("bd", "bx")).distinct()
        want = scratch.cut(wanted.groupBy("did", (F.shiftright("x", 32).cast("int")).alias("th")).agg(F.collect_list(F.col("x").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("lines")))
        bits = scratch.cut(id_bits(want.select("did").distinct(), "did"))
        got = docs.filter(maybe_in(bits, "did")).join(want, ["did", "th"]).select("did", "th", F.explode("lines").alias("line"), F.split("text", "\n", -1).alias("all"))
        got = scratch.cut(got.select("did", (F.shiftleft(F.col("th").cast("long"), 32) + F.col("line")).alias("x"), F.array_distinct(_hashes(F.get("all", F.col("line")))).alias("t")))
        two = pairs.join(got.selectExpr("did as bd", "x as bx", "t as y"), ["bd", "bx"]).join(got.selectExpr("did as ad", "x as ax", "t as z"), ["ad", "ax"])
        two = two.filter((100 + percent) * F.size(F.array_intersect("y", "z")) >= percent * (F.size("y") + F.size("z")))
        return scratch.cut(two.select("ad", "ax", "bd", "bx"))

    # classes of a word that has few of them meet at once; those of the other words are written, and meet their first
    small = rows.join(shared.filter(f"many <= {GROUP}").select("w"), "w", "left_semi").select("w", "did", "sub", "np", "sk")
    later = small.select("w", F.col("did").alias("bd"), F.col("sub").alias("bx"), F.col("np").alias("bnp"), F.col("sk").alias("bsk"))
    pairs = small.join(later, "w").filter(F.expr("did < bd or did = bd and sub < bx") & may("np", "bnp", "sk", "bsk"))
    pairs = scratch.cut(pairs.select(F.col("did").alias("ad"), F.col("sub").alias("ax"), "bd", "bx").distinct())
    crowd = scratch.cut(rows.join(shared.filter(f"many > {GROUP}").select("w"), "w", "left_semi").select("w", "did", "sub", "np", "sk"))
    scratch.sweep()
    lead = crowd.groupBy("w").agg(F.min(F.struct("did", "sub", "np", "sk")).alias("lead"))
    stars = crowd.join(lead, "w").filter(F.expr("not (did = lead.did and sub = lead.sub)") & may("np", "lead.np", "sk", "lead.sk"))
    stars = stars.select(F.col("lead.did").alias("ad"), F.col("lead.sub").alias("ax"), F.col("did").alias("bd"), F.col("sub").alias("bx"))
    # the earliest candidate of another document settles most lines; for the others all candidates are looked at
    best = pairs.groupBy("bd", "bx").agg(F.min(F.when(F.col("ad") != F.col("bd"), F.struct("ad", "ax"))).alias("a")).filter("a is not null")
    found = verified(best.select("a.ad", "a.ax", "bd", "bx").union(stars))
    settled = scratch.cut(found.filter("ad <> bd").select("bd", "bx").distinct())
    left = pairs.join(settled, ["bd", "bx"], "left_anti").select("ad", "ax", "bd", "bx")
    rest = crowd.join(settled.selectExpr("bd as did", "bx as sub"), ["did", "sub"], "left_anti")
    early = crowd.select("w", F.col("did").alias("ad"), F.col("sub").alias("ax"), F.col("np").alias("anp"), F.col("sk").alias("ask"))
    more = rest.join(early, "w").filter(F.expr("ad < did or ad = did and ax < sub") & may("np", "anp", "sk", "ask")).selectExpr("ad", "ax", "did as bd", "sub as bx")
    found = found.union(verified(left.union(more)))
    scratch.sweep()
    # the classes that go as a whole, then all occurrences
    gone = found.groupBy(F.col("bd").alias("did"), F.col("bx").alias("sub")).agg(F.max(F.expr("not (ad = bd and (ax >> 32) = (bx >> 32))")).alias("other"))
    per = classes.select("h1", "h2", "size", "did", "sub").join(gone, ["did", "sub"], "left").filter("size > 1 or other is not null")
    per = scratch.cut(per.select("h1", "h2", F.col("did").alias("fd"), F.col("sub").alias("fx"), "other"))
    out = lines.select("did", "sub", "h1", "h2").join(per, ["h1", "h2"]).filter("other is not null or not (did = fd and sub = fx)")
    elsewhere = F.coalesce("other", F.lit(False)) | F.expr("not (did = fd and (sub >> 32) = (fx >> 32))")
    return out.select("did", F.shiftright("sub", 32).cast("int").alias("th"), F.col("sub").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("line"), elsewhere.alias("elsewhere"))


def dedup_lines(docs: DataFrame, percent: int = 90, min_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """The rows of docs with the text that stays, the removed line numbers (array of int, ascending) and the share of
    the words of the text that went because another document has them, in lines of TELLING different words and more
    (double); with the names of these columns.

    Lines end at a newline. Blank lines and lines with fewer than ``min_words`` different words always stay. Ids are integers;
    rows with a null id come last. Rows with the same id and text are one document, and get the same result. A null
    text stays null, an empty one is one line. No row is lost.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    did, th, kept, removed, share, gone = fresh(docs, "__did", "__th", "kept_text", "removed_lines", "shared_words", "__gone")
    base = docs.withColumns({did: F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)), th: F.hash(text_col)})
    plain = base.filter(F.col(text_col).isNotNull()).select(F.col(did).alias("did"), F.col(th).alias("th"), F.col(text_col).alias("text"))
    found = scratch.cut(find_repeated_lines(plain, scratch, percent, min_words))
    per = found.groupBy(F.col("did").alias(did), F.col("th").alias(th)).agg(F.array_sort(F.collect_set(F.struct("line", "elsewhere"))).alias(gone))
    bits = scratch.cut(id_bits(found.select("did").distinct(), "did"))
    scratch.keep(found, bits)
    none = F.array().cast("array<int>")
    same = base.withColumns({kept: F.col(text_col), removed: none, share: F.lit(0.0)}).filter(~maybe_in(bits, did) | F.col(text_col).isNull())
    other = base.filter(maybe_in(bits, did) & F.col(text_col).isNotNull()).join(per, [did, th], "left")
    lines = F.split(text_col, "\n", -1)
    at = F.coalesce(F.transform(gone, lambda x: x["line"]), none)
    far = F.coalesce(F.transform(F.filter(gone, lambda x: x["elsewhere"]), lambda x: x["line"]), none)
    stay = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(removed), i)), "\n")
    count = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.size(F.split(x, " ", -1)))
    lost = F.filter(lines, lambda x, i: F.array_contains(far, i) & (F.size(F.array_distinct(F.split(x, " ", -1))) >= TELLING))
    other = other.withColumn(removed, at).withColumns({kept: F.when(F.size(removed) > 0, stay).otherwise(F.col(text_col)), share: F.when(F.size(removed) > 0, count(lost) / count(lines)).otherwise(0.0)})
    names = [*docs.columns, kept, removed, share]
    return same.select(*names).unionByName(other.select(*names)), [kept, removed, share]


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, the removed ones, and a digest of the text that stays."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out, (kept, removed, share) = dedup_lines(docs)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return out.select("doc_id", n.cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), F.array_join(F.col(removed).cast("array<string>"), ",").alias("removed"), F.sha2(F.col(kept), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], percent: int = 90, min_words: int = 1) -> dict[int, list[int]]:
    """Removed lines by id over a few rows, for tests."""
    seen: list[set[str]] = []
    out: dict[int, list[int]] = {}
    for doc, text in sorted(rows):
        out[doc] = []
        for i, line in enumerate(text.split("\n") if text is not None else []):
            s = set(line.split(" "))
            if len(s) < min_words or not re.search(_WORD, line):
                continue
            if any((100 + percent) * len(s & t) >= percent * (len(s) + len(t)) for t in seen if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t))):
                out[doc].append(i)
            seen.append(s)
    return out
