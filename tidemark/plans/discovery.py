"""Queries that compare motifs, find their sites, and tell sets of sequences apart by their words."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import controls as C, discovery as D, sequences as Q, stats as M
from ..streaming.windows import sliding_stream
from .queries import PROFILE, RC, SEQ, query, read, sequences, sites


def of_documents(spark, d, column: str) -> DataFrame:
    """The sequences of documents with one of their columns."""
    return sequences(spark, d).join(read(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), column), "seq_id")


@query()
def motif_comparison(spark, d):
    """The common word of each source, with its flanks, beside that of every document."""
    queries = D.seed_profiles(of_documents(spark, d, "source"), "source")
    targets = D.seed_profiles(sequences(spark, d), "seq_id")
    out = D.compare_motifs(queries, targets, least_overlap=6)
    return out.select("query", "target", "offset", "strand", "overlap", "score", *[F.round(c, 9).alias(c) for c in ("p_offset", "p_value", "e_value", "q_value")])


def after_tac(s: DataFrame) -> DataFrame:
    """The profile of the six letters that follow T, A, C."""
    return Q.position_profile(Q.words_after(s, "TAC", 6), 1.0)


def site_sql(gaps: str) -> str:
    """Every word of six letters with its score and tail, and every window of both strands with its word's."""
    return f"""with {SEQ}, bs as (select unnest(['A', 'C', 'G', 'T']) as b),
comp as (select b, sum(length(seq) - length(replace(seq, b, ''))) as n from sq, bs group by b), bg as (select b, n / (select sum(n) from comp) as share from comp),
nine as (select substr(seq, cast(i as int), 9) as w from (select seq, unnest(range(1, length(seq) - 7)) as i from sq where length(seq) >= 9)),
st as (select right(w, 6) as w from nine where starts_with(w, 'TAC')), lt as (select i - 1 as col, substr(w, cast(i as int), 1) as b from (select w, unnest(range(1, 7)) as i from st)),
pr as (select c as col, bs.b, (count(lt.b) + 1) / ((select count(*) from st) + 4) as freq from range(0, 6) t(c) cross join bs left join lt on lt.col = c and lt.b = bs.b group by c, bs.b),
sc as (select col, pr.b, share, case when pr.col in ({gaps}) then 0 else cast(floor(log2(freq / share) * 100 + 0.5) as bigint) end as s from pr join bg on bg.b = pr.b),
wd as (select a.b || c.b || e.b || f.b || g.b || h.b as kmer, a.s + c.s + e.s + f.s + g.s + h.s as score, a.share * c.share * e.share * f.share * g.share * h.share as p
  from sc a, sc c, sc e, sc f, sc g, sc h where a.col = 0 and c.col = 1 and e.col = 2 and f.col = 3 and g.col = 4 and h.col = 5),
tl as (select score, sum(sum(p)) over (order by score desc) as tail from wd group by score),
db as (select seq_id, 1 as strand, seq from sq union all select seq_id, -1, {RC} from sq),
win as (select seq_id, strand, cast(i - 1 as int) as pos, substr(seq, cast(i as int), 6) as kmer from (select *, unnest(range(1, length(seq) - 4)) as i from db where length(seq) >= 6)),
hit as (select win.*, score from win join wd using (kmer)), ct as (select score, count(*) as n from hit group by score),
rk as (select score, tail * (select sum(n) from ct) / sum(n) over (order by score desc) as raw from ct join tl using (score)),
qv as (select score, least(1.0, min(raw) over (order by score)) as q from rk)"""


@query(site_sql("-1") + """
select seq_id, strand, pos, kmer, score, round(tail, 9) as p_value, round(q, 9) as q_value from hit join tl using (score) join qv using (score) where tail <= 0.005""")
def profile_site_pvalues(spark, d):
    s = sequences(spark, d)
    background = {r["base"]: float(r["n"]) for r in Q.composition(s).collect()}  # four letters
    hits = D.profile_sites(s, after_tac(s), background, most_p=0.005)
    return hits.select("seq_id", "strand", "pos", "kmer", "score", F.round("p_value", 9).alias("p_value"), F.round("q_value", 9).alias("q_value"))


def english(spark, d) -> DataFrame:
    return of_documents(spark, d, "lang").withColumn("positive", F.col("lang") == "en")


@query(f"""with {SEQ}, w as (select seq_id, substr(seq, cast(i as int), 6) as w from (select *, unnest(range(1, length(seq) - 4)) as i from sq where length(seq) >= 6)),
h as (select distinct seq_id, least(w, {RC.replace("seq", "w")}) as word from w)
select word, count(*) filter (lang = 'en') as pos, count(*) filter (lang <> 'en') as neg from h join documents on doc_id = seq_id where lang is not null group by word""")
def word_presence(spark, d):
    return D.word_counts(D.held_words(english(spark, d), 6), 6)


@query()
def discriminative_words(spark, d):
    return D.discriminative_words(english(spark, d), k=6, beam=20, most=3)


@query(site_sql("1, 4") + " select score, count(*) as n, count(distinct seq_id) as sequences, round(max(tail), 9) as p_value, round(max(q), 9) as q_value from hit join tl using (score) join qv using (score) where tail <= 0.02 group by score")
def gapped_profile_sites(spark, d):
    """The same profile with two of its columns taken out."""
    s = sequences(spark, d)
    background = {r["base"]: float(r["n"]) for r in Q.composition(s).collect()}  # four letters
    hits = D.profile_sites(s, Q.gap_columns(after_tac(s), [1, 4]), background, most_p=0.02)
    return hits.groupBy("score").agg(F.count("*").alias("n"), F.count_distinct("seq_id").alias("sequences"), F.round(F.max("p_value"), 9).alias("p_value"), F.round(F.max("q_value"), 9).alias("q_value"))


@query(f"with {SEQ} select substr(seq, cast(i as int), 2) as pair, count(*) as n from (select seq, unnest(range(1, length(seq))) as i from sq where length(seq) >= 2) group by 1")
def shuffled_pairs(spark, d):
    """Letter pairs of all sequences after shuffling, which are those before."""
    made = C.pair_shuffled(sequences(spark, d), seed=7)
    return Q.word_counts(made, 2).withColumnRenamed("word", "pair")


#: Middle letters in which sites are looked for, and the letters of a site.
MIDDLE, SITE = 120, 6


def central(spark, d) -> DataFrame:
    s = sequences(spark, d)
    return C.central_distances(s, after_tac(s), MIDDLE, most_p=0.01)


@query(f"""with {SEQ}, bs as (select unnest(['A', 'C', 'G', 'T']) as b),
nine as (select substr(seq, cast(i as int), 9) as w from (select seq, unnest(range(1, length(seq) - 7)) as i from sq where length(seq) >= 9)),
st as (select right(w, 6) as w from nine where starts_with(w, 'TAC')), lt as (select i - 1 as col, substr(w, cast(i as int), 1) as b from (select w, unnest(range(1, 7)) as i from st)),
pr as (select c as col, bs.b, (count(lt.b) + 1) / ((select count(*) from st) + 4) as freq from range(0, 6) t(c) cross join bs left join lt on lt.col = c and lt.b = bs.b group by c, bs.b),
sc as (select col, b, cast(floor(log2(freq / 0.25) * 100 + 0.5) as bigint) as s from pr),
wd as (select a.b || c.b || e.b || f.b || g.b || h.b as kmer, a.s + c.s + e.s + f.s + g.s + h.s as score from sc a, sc c, sc e, sc f, sc g, sc h where a.col = 0 and c.col = 1 and e.col = 2 and f.col = 3 and g.col = 4 and h.col = 5),
tl as (select score, sum(count(*)) over (order by score desc) / 4096 as tail from wd group by score),
mid as (select seq_id, substr(seq, cast((length(seq) - {MIDDLE}) // 2 + 1 as int), {MIDDLE}) as seq from sq where length(seq) >= {MIDDLE}),
db as (select seq_id, 1 as strand, seq from mid union all select seq_id, -1, {RC} from mid),
win as (select seq_id, strand, case when strand > 0 then i - 1 else {MIDDLE} - {SITE} - i + 1 end as place, substr(seq, cast(i as int), 6) as kmer from (select *, unnest(range(1, {MIDDLE} - {SITE} + 2)) as i from db)),
best as (select seq_id, place from win join wd using (kmer) join tl using (score) where tail <= 0.01 qualify row_number() over (partition by seq_id order by score desc, md5(concat_ws('|', seq_id, strand, place))) = 1)
select cast(abs(2 * place - ({MIDDLE} - {SITE})) as int) as distance, count(*) as n from best group by 1""")
def central_site_distances(spark, d):
    return central(spark, d)


@query()
def central_site_windows(spark, d):
    """Whether the sites of a profile gather about the middle of the sequences."""
    return C.central_enrichment(central(spark, d), MIDDLE - SITE + 1)


@query()
def smooth_concurvity(spark, d):
    out = M.concurvity(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.withColumns({c: F.round(c, 6) for c in ("share", "worst")})


# -- profiles and time -----------------------------------------------------------------------------------------------

@query(f"with {PROFILE} select 11 - col as col, translate(base, 'ACGT', 'TGCA') as base, round(freq, 9) as freq from pr")
def reversed_profile(spark, d):
    p = Q.reverse_profile(Q.position_profile(sites(spark, d)))
    return p.select("col", "base", F.round("freq", 9).alias("freq"))


@query(f"with {PROFILE} select c as col, b as base, coalesce(round(freq, 9), 0.25) as freq, freq is null as is_gap from range(0, 12) x(c) cross join (values ('A'), ('C'), ('G'), ('T')) y(b) left join pr on pr.col = c + 2 and pr.base = b")
def shifted_profile(spark, d):
    p = Q.shift_profile(Q.position_profile(sites(spark, d)), 2, 12)
    return p.select(F.col("col").cast("long").alias("col"), "base", F.round("freq", 9).alias("freq"), "is_gap")


@query(f"""with {PROFILE}, s as (select col, 2 + sum(case when freq > 1e-10 then freq * log2(freq) else 0 end) as bits from pr where col not in (0, 11) group by col)
select pr.col, base, round(coalesce(freq * bits, 0), 9) as height from pr left join s on s.col = pr.col""")
def gapped_logo(spark, d):
    p = Q.profile_logo(Q.gap_columns(Q.position_profile(sites(spark, d)), [0, 11]))
    return p.select(F.col("col").cast("long").alias("col"), "base", F.round("height", 9).alias("height"))


@query("select start, event_type, count(*) as n from (select event_type, unnest([epoch_us(time_bucket(interval '2 hours', ts)) // 1000000 - 7200 * k for k in range(0, 3)]) as start from events) group by all")
def sliding_time_windows(spark, d):
    t = sliding_stream(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", "2 hours", ["event_type"])
    return t.select(F.unix_seconds("start").alias("start"), "event_type", "n")
