"""The registered queries of the operators, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm import bpe, collocations, decontaminate, exact, langid, licenses, lines, periodic, pii, sharding, simhash, substrings, tokencache
from panelmill.sources.files import shared_folder
from panelmill.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(job):
        QUERIES[job.__name__] = job
        if sql is not None:
            SQL[job.__name__] = sql
        return job

    return put


@query()
def op1_hash_tree_shards(spark: SparkSession, folder: str) -> DataFrame:
    tree = sharding.even_tree(8)
    return sharding.placed(table(spark, folder, "documents"), tree, sharding.grown(tree, 8))


#: The rank file and pattern of the tokenizer; the file lies beside the installed package.
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def token_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded and decoded rows."""
    tokens = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS)
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op2_merge_replay_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return token_digests(table(spark, folder, "documents"))


def invented_path(number: Column) -> Column:
    hundreds = F.when(number % 1000 != 0, (F.floor(number / 100) % 10).cast("string"))  # concat_ws leaves out a null
    return F.concat_ws("/", "source", F.floor(number / 1000).cast("string"), hundreds, number.cast("string"))


@query()
def op3_licence_inheritance(spark: SparkSession, folder: str) -> DataFrame:
    """The documents have no paths: they lie in <source>/<thousands>/<hundreds>/<doc_id>, the first of a thousand in <source>/<thousands>."""
    return licenses.inherited(licenses.stated(table(spark, folder, "documents"), invented_path(F.col("doc_id"))))


@query()
def op4_bitmask_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(langid.remainder("doc_id") == 0, F.lit(False)).alias("held_out")
    return langid.predict(docs, langid.fit(docs)).select("doc_id", held_out, "lang_pred", "score")


@query()
def op5_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    removed = lines.removed_lines(table(spark, folder, "documents"))
    return removed.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


@query()
def op7_latent_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(r"""
with texts as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as (
  select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from texts where len(w) >= 50)
), repeated as (
  select doc_id, i from windows join (select h, min(doc_id) as least from windows group by h) using (h) where least < doc_id
), covered as (
  select distinct doc_id, unnest(range(i, i + 50)) as i from repeated
), kept as (
  select doc_id, string_agg(word, ' ' order by i) as k, count(*) as n
  from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from texts) anti join covered using (doc_id, i) group by doc_id
)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(k, '')) as kept_sha256 from texts left join kept using (doc_id)
""")
def op6_seed_extend_substrings(spark: SparkSession, folder: str) -> DataFrame:
    ranges = F.aggregate("repeats", F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["start"]))
    return substrings.without_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_words", ranges.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query(r"""
with texts as (
  select doc_id, length(coalesce(text, '')) as points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents
)
select doc_id, first_value(doc_id) over best as keep_id, count(*) over (partition by text_sha256) as group_size,
  row_number() over best = 1 as kept, text_sha256
from texts window best as (partition by text_sha256 order by points desc, doc_id)
""")
def op8_digest_tree_dedup(spark: SparkSession, folder: str) -> DataFrame:
    decided = exact.decide(table(spark, folder, "documents"))
    return decided.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query()
def op9_deobfuscated_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.detect(table(spark, folder, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(kind):
        return F.filter(base, lambda s: s["kind"] == kind)

    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )


@query()
def op10_vantage_tree_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query(r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), lists as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), places as (
  select lang, w, unnest(range(1, len(w) + 1)) as i from lists where len(w) > 0
), grams as (
  select lang, w[i] as w1, case when i < len(w) then w[i + 1] end as w2, case when i + 1 < len(w) then w[i + 2] end as w3 from places
), ones as (
  select lang, w1, count(*) as f from grams group by all
), twos as (
  select lang, w1, w2, count(*) as f from grams where w2 is not null group by all having count(*) >= 10
), threes as (
  select lang, w1, w2, w3, count(*) as f from grams where w3 is not null group by all having count(*) >= 10
), longer as (
  select lang, w1, w2, max(f) as f
  from (select lang, w1, w2, f from threes union all select lang, w2, w3, f from threes) group by all
), cuts as (
  select t.lang, concat_ws(' ', t.w1, t.w2) as phrase, t.f as a, 1 as k, l.f as l, r.f as r
  from twos t join ones l on l.lang = t.lang and l.w1 = t.w1 join ones r on r.lang = t.lang and r.w1 = t.w2
    left join longer m on m.lang = t.lang and m.w1 = t.w1 and m.w2 = t.w2
  where 100 * coalesce(m.f, 0) < 50 * t.f
  union all
  select t.lang, concat_ws(' ', t.w1, t.w2, t.w3), t.f, 1, l.f, r.f
  from threes t join ones l on l.lang = t.lang and l.w1 = t.w1 join twos r on r.lang = t.lang and r.w1 = t.w2 and r.w2 = t.w3
  union all
  select t.lang, concat_ws(' ', t.w1, t.w2, t.w3), t.f, 2, l.f, r.f
  from threes t join twos l on l.lang = t.lang and l.w1 = t.w1 and l.w2 = t.w2 join ones r on r.lang = t.lang and r.w1 = t.w3
), scored as (
  select *, cast(1000000::hugeint * a * a // (l::hugeint * r) as bigint) as score from cuts
), weakest as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from weakest
)
select lang, rank, phrase, a, l, r, (select sum(f)::bigint from ones o where o.lang = ranked.lang) as n, score
from ranked where rank <= 2000
""")
def op11_graph_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.phrases(table(spark, folder, "documents"), least=10, share=50, top=2_000).drop("path_words")


@query()
def op12_automaton_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.detect(table(spark, folder, "documents"), plant=True).drop("runs")


#: The tokenizer whose counts are kept, the most tokens of a document that fits, and the setting that names a cache to go on with.
COUNTED, LIMIT, CACHE_AT = public_tokenizers.path("word_bpe_49k.json"), 2048, "spark.panelmill.tokenCounts"


@query()
def op13_digest_cache_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A session that names no cache gets a new one beside its checkpoints."""
    cache = spark.conf.get(CACHE_AT, None) or shared_folder(spark, "token-counts")
    counts = tokencache.counted(table(spark, folder, "documents"), tokencache.Tokenizer.of(COUNTED), cache)
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
