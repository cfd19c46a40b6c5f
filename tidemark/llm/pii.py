"""Personal data: patterns with checks, and bootstrapped contextual extraction of what they miss.

*Base.* Four kinds are matched by regular expression, leftmost and without overlap, and checked: email, ip (parts up
to 255), card (16 to 19 digits, Luhn), phone (8 to 15 digits). Positions follow from the lengths of the pieces
between the matches.

*Bootstrapping.* The values found are seeds, and so are words that look like secrets (long hexadecimal strings, keys
with a known beginning), for a fifth kind. A seed's lexical patterns are its contexts: the two words before it, the
last word before it with the signs up to it, and that word with the one after it. Whatever looks like an identifier (a
digit or an @, and not in a base span) in the same context is an instance of the pattern. Patterns and instances form
a graph that is scored in turns: a pattern, for a kind, by the mean score of all distinct instances that it holds,
those of other kinds counting nothing; an instance by its best pattern. So a word that stands before anything, such as
an article, is no pattern of anything. Patterns with enough distinct seeds and a high score then extract their
instances, where these have the loose shape of the kind and its check does not refuse them.

Built-in functions only. Regular expressions use possessive quantifiers and lookbehinds, so that very long texts
take linear time and no deep recursion; the matches are those of the plain forms. Positions are running sums in
chunks, contexts are cut from the pieces between the matches, and candidates meet the base spans in a sorted sweep, so
a text with a million candidates takes time in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Scratch, fresh, read

#: The kinds in their order, with their patterns and a character that every match holds.
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
#: The kind that only the method adds.
SECRET = "secret"
#: What looks like an identifier: a word with a digit or an @, and the groups of digits after it.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[0-9().-]++(?!\S))*+"
#: Seeds of secrets. Hexadecimal strings of 32 digits and more, and keys with the usual beginnings.
SECRET_SEED = r"(?=[0-9a-fA-F]*[a-fA-F])(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{32,512}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk[-_][0-9A-Za-z_-]{20,200}|xox[abprs]-[0-9A-Za-z-]{10,200}|AIza[0-9A-Za-z_-]{35}"
#: Loose shapes of the kinds: a whole candidate must match.
LOOSE = {
    "email": r"[^\s@]+@[^\s@]+",
    "ip": r"[0-9]{1,3}(?:[.:-][0-9]{1,3}){3,5}",
    "card": r"(?:[0-9][\x20.-]?){12,19}",
    "phone": r"\+?(?:[0-9][\x20().-]{0,3}){7,15}",
    SECRET: r"(?=[^\s]*[A-Za-z])[0-9A-Za-z_./+=~-]{8,512}",
}
#: Rounds of scoring; distinct seeds a pattern needs; the score from which it extracts.
ROUNDS, MIN_SEEDS, MIN_SCORE = 3, 3, 0.7
#: Characters before and after a match in which its words are looked for.
BEFORE, AFTER = 80, 40
#: Matches of a text whose positions are summed together.
CHUNK = 512


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    digits = F.transform(F.filter(F.split(F.reverse(_digits(text)), ""), lambda d: d != ""), lambda d: d.cast("int"))
    worth = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        # leading zeros do not count
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return n.between(16, 19) & _luhn(m)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


_SPAN = "array<struct<kind:string,s:int,e:int,v:string>>"
_FULL = "array<struct<kind:string,s:int,e:int,v:string,l:string,r:string>>"


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _placed(gaps: Column, kind: str) -> Column:
    """Structs (m, g, n, l, r) with a gap g before each match of n characters, as structs of _FULL.

    Appending to an array copies it, so positions are summed in chunks, whose starts are summed before.
    """

    def chunked(all_: Column) -> Column:
        last = F.greatest(F.ceil(F.size(all_) / CHUNK).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(all_, i * CHUNK + 1, F.lit(CHUNK)))

    def starts(sums: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(sums, first, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def spans(chunk: Column, at: Column) -> Column:
        first = F.struct(at.alias("at"), F.array().cast(_FULL).alias("out"))

        def step(a: Column, x: Column) -> Column:
            s = a["at"] + x["g"]
            made = F.struct(F.lit(kind).alias("kind"), s.alias("s"), (s + x["n"]).alias("e"), x["m"].alias("v"), x["l"].alias("l"), x["r"].alias("r"))
            return F.struct((s + x["n"]).alias("at"), F.concat(a["out"], F.array(made)).alias("out"))

        return F.aggregate(chunk, first, step, lambda a: a["out"])

    def whole(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["g"] + x["n"]))
        return F.flatten(F.zip_with(chunks, starts(sums), spans))

    return _let(gaps, lambda all_: _let(chunked(all_), whole))


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """All matches as structs of _FULL in order; positions in characters, end exclusive, with what stands around."""

    def gaps(found: Column, pieces: Column) -> Column:
        n = F.size(found)
        before = F.concat(F.array(F.lit("")), F.slice(found, F.lit(1), F.greatest(n - 1, F.lit(0))))
        left = F.zip_with(before, F.slice(pieces, F.lit(1), n), lambda b, p: F.struct(F.length(p).alias("g"), F.right(F.concat(F.right(b, F.lit(BEFORE)), p), F.lit(BEFORE)).alias("l")))
        right = F.zip_with(found, F.slice(pieces, F.lit(2), n), lambda m, p: F.struct(m.alias("m"), F.length(m).alias("n"), F.left(p, F.lit(AFTER)).alias("r")))
        return F.zip_with(left, right, lambda a, b: F.struct(b["m"].alias("m"), a["g"].alias("g"), b["n"].alias("n"), a["l"].alias("l"), b["r"].alias("r")))

    none = F.array().cast(_FULL)
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return _let(found, lambda f: F.when(F.size(f) == 0, none).otherwise(_let(pieces, lambda p: _placed(gaps(f, p), kind))))


def _checker(kind: str):
    return lambda x: _valid(kind, x["v"])


def _is(kind: str):
    return lambda x: x["kind"] == kind


def base_spans(text: Column) -> dict[str, Column]:
    """Of each kind the valid matches, with what stands around them."""
    out = {}
    for kind, (pattern, sign) in KINDS.items():
        some = text.rlike("[0-9]") if sign is None else F.contains(text, F.lit(sign)) & (text.rlike("[0-9]") if kind != "email" else F.lit(True))
        valid = F.filter(_matches(text, pattern, kind), _checker(kind))
        out[kind] = F.when(some, valid).otherwise(F.array().cast(_FULL))
    return out


def _patterns(left: Column, right: Column) -> Column:
    """The lexical patterns of a value between two contexts: an array of strings without nulls."""
    low = F.lower(left)
    words = F.filter(F.split(low, r"[^\p{L}\p{N}_@.+-]+"), lambda w: w != "")
    last = F.regexp_replace(F.regexp_extract(low, r"([\p{L}_-]+)([^\p{L}\p{N}]*)$", 0), r"\s+", " ")
    after = F.regexp_extract(F.lower(right), r"^[^\p{L}\p{N}]*([\p{L}_-]+)", 1)
    two = F.when(F.size(words) >= 2, F.concat(F.lit("2:"), F.array_join(F.slice(words, -2, 2), " ")))
    one = F.when(last != "", F.concat(F.lit("1:"), last))
    around = F.when((last != "") & (after != ""), F.concat(F.lit("3:"), last, F.lit("_"), after))
    return F.filter(F.array(two, one, around), lambda p: p.isNotNull())


def _listed(spans: Column) -> Column:
    """kind:start:end joined by commas, by kind as listed, then start."""
    order = {k: i for i, k in enumerate([*KINDS, SECRET])}
    rank = lambda k: sum((F.when(k == n, i).otherwise(0) for n, i in order.items()), F.lit(0))
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(rank(x["kind"]).alias("r"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("k"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _free(rows: DataFrame) -> DataFrame:
    """Candidates (kind null) among rows (rid, kind, s, e, v, l, r) that overlap no base span, by a sorted sweep."""
    at = F.when(F.col("kind").isNull(), F.col("e")).otherwise(F.col("s"))
    # of the base spans that begin before a candidate's end, the last end
    reach = F.expr("max(case when kind is not null then e end) over (partition by rid order by at, case when kind is null then 0 else 1 end rows between unbounded preceding and current row)")
    swept = rows.withColumn("at", at).withColumn("reach", reach)
    return swept.filter("kind is null and (reach is null or reach <= s)").drop("at", "reach", "kind")


def find_pii(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """The rows of docs without the text, with base and added spans (arrays of kind, s, e, v), and their names.

    Positions are characters, end exclusive. Null and empty texts have no spans. A value that repeats is found each
    time. Rows are told apart by their place in the input, so equal rows and equal ids keep their own results; equal
    texts get equal ones. Of kinds that tie for a span the one with the greater name is taken.
    """
    scratch = Scratch(docs.sparkSession)
    rid, base, added, cand = fresh(docs, "__rid", "base_spans", "added_spans", "__candidates")
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in docs.columns if c != text_col]
    looks = F.when(text.rlike("[0-9@]"), _matches(text, CANDIDATE, "?")).otherwise(F.array().cast(_FULL))
    first = docs.select(*kept, F.monotonically_increasing_id().alias(rid), F.concat(*base_spans(text).values()).alias(base), looks.alias(cand))
    first = scratch.cut(first)
    cells = lambda c: first.filter(F.size(c) > 0).select(F.col(rid).alias("rid"), F.explode(c).alias("x"))
    seeds = cells(base).select("rid", "x.*")
    looks = _free(seeds.unionByName(cells(cand).select("rid", "x.*").withColumn("kind", F.lit(None).cast("string"))))
    # signs at the ends are not part of the value
    ahead = F.regexp_extract("v", r"^[\"'(<\[{=:]+", 0)
    value = F.regexp_replace("v", r"^[\"'(<\[{=:]+|[\"')>\]}.,;:!?=*#&$%|]+$", "")
    start = F.col("s") + F.length(ahead)
    looks = looks.select("rid", start.alias("s"), (start + F.length(value)).alias("e"), value.alias("v"), _patterns(F.concat("l", ahead), F.concat(F.regexp_extract("v", r"[\"')>\]}.,;:!?=*#&$%|]*$", 0), "r")).alias("ps"))
    looks = scratch.cut(looks.filter("v <> ''"))

    # the graph: pattern, instance (value), the kind of which it is a seed or none; one row for each distinct pair
    is_secret = F.when(F.col("v").rlike(f"^(?:{SECRET_SEED})$"), F.lit(SECRET))
    known = seeds.select(F.explode(_patterns(F.col("l"), F.col("r"))).alias("p"), "v", F.col("kind").alias("k"))
    known = known.union(looks.select(F.explode("ps").alias("p"), "v", is_secret.alias("k")))
    edges = scratch.cut(known.groupBy("p", "v").agg(F.max("k").alias("seed")))
    strong = scratch.cut(edges.filter("seed is not null").groupBy("p", F.col("seed").alias("k")).agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_SEEDS).select("p", "k"))
    shape = F.lit(False)
    for kind, loose in LOOSE.items():
        refused = F.lit(False)
        if kind == "card":  # as many digits as a card has, and the check fails
            refused = F.length(_digits(F.col("v"))).between(16, 19) & ~_luhn(F.col("v"))
        shape = shape | ((F.col("k") == kind) & F.col("v").rlike(f"^(?:{loose})$") & ~refused)
    # an instance of a pattern can be of the pattern's kind, or it tells against it
    graph = edges.join(strong, "p").select("p", "k", "v", (F.col("seed") == F.col("k")).alias("yes"), F.col("seed").isNotNull().alias("known"))
    graph = graph.withColumn("yes", F.coalesce("yes", F.lit(False))).withColumn("may", F.col("yes") | (~F.col("known") & shape))
    graph = scratch.cut(graph)
    totals = graph.groupBy("p", "k").agg(F.count("*").alias("n"))
    score = graph.filter("may").groupBy("k", "v").agg(F.max(F.col("yes").cast("double")).alias("score"))
    pattern = None
    for _ in range(ROUNDS):
        sums = graph.filter("may").join(score, ["k", "v"]).groupBy("p", "k").agg(F.sum("score").alias("sum"))
        pattern = scratch.cut(sums.join(totals, ["p", "k"]).select("p", "k", (F.col("sum") / (F.col("n") + F.lit(0.5))).alias("trust")))
        score = scratch.cut(graph.filter("may").join(pattern, ["p", "k"]).groupBy("k", "v").agg(F.max(F.when(F.col("yes"), 1.0).otherwise(F.col("trust"))).alias("score")))
    # seeds of base kinds are base spans already; those of secrets are extracted like others
    good = graph.filter(F.col("may") & (~F.col("yes") | (F.col("k") == SECRET))).join(pattern.filter(F.col("trust") >= MIN_SCORE), ["p", "k"]).join(score.filter(F.col("score") >= MIN_SCORE), ["k", "v"])
    good = good.groupBy("p", "v").agg(F.max(F.struct("trust", "k")).alias("x")).select("p", "v", "x")
    more = looks.select("rid", "s", "e", "v", F.explode("ps").alias("p")).join(good, ["p", "v"])
    more = more.groupBy("rid", "s", "e", "v").agg(F.max("x").alias("x")).select("rid", F.struct(F.col("x.k").alias("kind"), "s", "e", "v").alias("x"))
    more = more.groupBy(F.col("rid").alias(rid)).agg(F.array_sort(F.collect_list("x")).alias(added))
    plain = F.transform(base, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))
    out = first.select(*kept, rid, plain.alias(base)).join(more, rid, "left").withColumn(added, F.coalesce(F.col(added).cast(_SPAN), F.array().cast(_SPAN)))
    return out.select(*kept, base, added), [base, added]


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base spans by kind and digest, all spans, and how many there are."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out, (base, added) = find_pii(docs)
    counts = [F.size(F.filter(base, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    secrets = F.size(F.filter(added, _is(SECRET))).cast("long").alias("n_secret")
    every = F.concat(base, added)
    return out.select("doc_id", *counts, F.sha2(_listed(F.col(base)), 256).alias("base_sha256"), _listed(every).alias("spans"), F.size(added).cast("long").alias("n_added"), secrets, F.size(every).cast("long").alias("n_spans"))


def brute_force(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Base spans by kind of one text, in plain Python, for tests."""
    import re

    text, out = text or "", {}
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind: str, m: str) -> bool:
        d = [int(c) for c in m if c.isascii() and c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    for kind, p in plain.items():
        out[kind] = [m.span() for m in re.finditer(p, text) if ok(kind, m[0])]
    return out
