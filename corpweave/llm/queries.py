"""Queries of the training-data operators: op<N>_<name>, each over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpweave.llm import decontaminate, language, licenses, negatives, packing, pii, quality, rules, simhash, topk, trie, urls, warc
from corpweave.session import cut

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return add


#: The key of the pseudonyms in the registered queries; a real run takes its own from a secret store.
PII_KEY = "registered query, not a secret"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of license texts and notices in all documents."""
    return licenses.scanned(_table(spark, sf_dir, "documents"))


@_query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out; ``rejected`` marks narrow margins."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = language.dictionaries(docs.where(~F.coalesce(held_out(), F.lit(False))))
    found = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), language.identify(F.col("text"), learned).alias("f"))
    return found.select("doc_id", "held_out", F.col("f.lang").alias("lang_pred"), "f.score", "f.margin", "f.rejected")


_RULES = [("org/", True), ("example.org/es/", False), ("example.org/en/1", False), ("com/fr/", True), ("com/de/", False)]
#: Globs for hosts that are blocked where no rule fits.
_BLOCKED = ["spam", "casino", "pills", "adult", "bets", "ads-track", "phish", "malware"]

_OP3_SQL = """
with p as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages
), r as (
  select page_id, host, path, case
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end as rule from p
)
select page_id, host, path, rule, case
    when rule in ('org/', 'com/fr/') then 'allow'
    when rule is not null then 'block'
    when regexp_matches(host, 'spam|casino|pills|adult|bets|ads-track|phish|malware') then 'block' else 'allow' end as verdict from r
"""


@_query("op3_url_filter", _OP3_SQL)
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every page's URL: the longest rule that fits, else the blocked globs."""
    rules = [r for text, allow in _RULES for r in urls.prefix_rules(text, allow, base=1)]
    rules += [urls.Rule(f"*{w}**", f"*{w}**", False, 0) for w in _BLOCKED]
    found = urls.judged(_table(spark, sf_dir, "pages"), rules)
    own = F.when(F.col("rule").isin([t for t, _ in _RULES]), F.col("rule"))
    return found.select("page_id", "host", "path", own.alias("rule"), "verdict")


_OP4_SQL = """
with v as (
  select row_number() over () as row, vec_id, [floor(256 * cast(x as double)) for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null and len([1 for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select q.row as asker, q.vec_id as query_id, c.vec_id as vec_id, cast(case
      when len(q.v) = len(c.v) and len(q.v) > 0 then list_dot_product(q.v, c.v)
      else coalesce(list_sum([coalesce(q.v[i], 0) * coalesce(c.v[i], 0) for i in range(1, least(len(q.v), len(c.v)) + 1)]), 0) end as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.row <> c.row
), r as (
  select query_id, cast(row_number() over (partition by asker order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select * from r where rank <= 5
"""


@_query("op4_exact_topk", _OP4_SQL)
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every row whose id is divisible by 50 against all other rows."""
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@_query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and their components at three or fewer differing bits."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


@_query("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all documents with pseudonyms, and what was replaced."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.pseudonymised(docs, PII_KEY, findings_col="findings")
    return found.select("doc_id", "text", F.size("findings").alias("n_found"), F.col("findings.kind").alias("kinds"), F.col("findings.start").alias("starts"), F.col("findings.pseudonym").alias("pseudonyms"))


def _op7_sql() -> str:
    text = "payload"
    for pattern, replacement in warc.STEPS:
        p, r = (x.replace("'", "''").replace("\n", "\\n") for x in (pattern, replacement))
        r = {"\\n": "' || chr(10) || '"}.get(r, r)
        text = f"regexp_replace({text}, '{p}', '{r}', 'g')"
    uuid = "'<urn:uuid:' || substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12) || '>'".format
    return f"""
with p as (
  select page_id, coalesce(url, '') as target_uri, coalesce(html, '') as payload from pages
), d as (
  select *, 'sha256:' || sha256(payload) as payload_digest from p
), r as (
  select *, sha256(concat_ws('|', coalesce(cast(page_id as varchar), ''), target_uri, payload_digest)) as h,
    [regexp_extract(x, '{warc.HREF}', 1) for x in regexp_extract_all(payload, '{warc.ANCHOR}') if regexp_matches(x, '{warc.HREF}')] as links,
    regexp_replace(regexp_extract(payload, '{warc.TITLE}', 1), '[ \\t\\r\\n\\f]+', ' ', 'g') as title from d
), k as (
  select page_id, 'metadata' as type, {uuid("h")} as refers_to, target_uri, payload_digest,
    concat_ws(chr(10), 'title: ' || title, 'source-digest: ' || payload_digest, 'source-http: HTTP/1.1 200 OK; Content-Type: text/html; charset=utf-8',
      case when len(links) > 0 then array_to_string(['outlink: ' || x for x in links], chr(10)) end) as block from r
  union all
  select page_id, 'conversion', {uuid("h")}, target_uri, payload_digest, {text} from r
), m as (select *, sha256(refers_to || '|' || type) as h2 from k)
select page_id, type, {uuid("h2")} as record_id, refers_to, target_uri, block, 'sha256:' || sha256(block) as block_digest, payload_digest,
  cast(octet_length(encode(block)) as integer) as content_length from m
"""


@_query("op7_warc_derivatives", _op7_sql())
def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages."""
    made = warc.derivatives(warc.responses(_table(spark, sf_dir, "pages")))
    return made.select(F.col("key").alias("page_id"), "type", "record_id", "refers_to", "target_uri", "block", "block_digest", "payload_digest", F.octet_length("block").alias("content_length"))


@_query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels of documents that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs.where(~F.coalesce(held_out(), F.lit(False))), _table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), quality.score_column(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


@_query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.tokenised(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(cut(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")))


_OP10_SQL = """
with lowered as (
  select 'd' as kind, doc_id as id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
  union all
  select 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark
), worded as (
  select kind, id, coalesce(regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w from lowered
), item_windows as (
  select distinct id as item_id, least(len(w), 10) as size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as win
  from (select id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from worded where kind = 'b' and len(w) > 0)
), doc_windows as (
  select id as doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') as win
  from (select id, w, size, unnest(range(1, len(w) - size + 2)) as i
        from worded, (select distinct size from item_windows) where kind = 'd' and len(w) >= size)
), found as (
  select doc_id, i, d.size as size, item_id from doc_windows d join item_windows b on d.win = b.win and d.size = b.size
), words_hit as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from found) group by doc_id
), items_hit as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id
)
select id as doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from worded left join words_hit on id = words_hit.doc_id left join items_hit on id = items_hit.doc_id where kind = 'd'
"""


@_query("op10_decontamination", _OP10_SQL)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a ten-word window of a benchmark item, and those items."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scanned(docs, _table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.flatten(F.col("hits.items"))))
    rows = found.select("doc_id", "n_words", "n_hit", items.alias("items"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _op11_sql() -> str:
    word, edges = "[^\\x20\\x09-\\x0D]+", "[.,;:!?]"
    sets = ["a-z", "A-Z", "0-9", "\\n", " \\t\\r\\x0B\\x0C", ".,;:?", "!", "#*$%&|<>", "()\\[\\]{}\'\'\"/\\\\_=+@-"]
    each = ", ".join(f"length(regexp_replace(t, '[^{x}]', '', 'g'))" for x in sets)
    part = "case when {0} > 0 then {0} * log2({0} / (({0} + {1}) / 2)) else 0 end + case when {1} > 0 then {1} * log2({1} / (({0} + {1}) / 2)) else 0 end".format
    return f"""
with d as (
  select row_number() over () as r, doc_id, lang, text is null as missing, coalesce(text, '') as t from documents
), w as (
  select *, regexp_extract_all(t, '{word}') as w, [x for x in string_split(t, chr(10)) if regexp_matches(x, '{word}')] as lines, [{each}] as h,
    length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')) as ascii,
    regexp_extract_all(regexp_replace(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{edges}', '', 'g'), '{word}') as p from d
), windows as (
  select r, i, count(*) over (partition by r, array_to_string(w[i : i + {rules.WINDOW - 1}], ' ')) as c from (select r, w, unnest(range(1, len(w) - {rules.WINDOW - 2})) as i from w)
), again as (
  select r, count(distinct i + k) as n from windows, range(0, {rules.WINDOW}) x(k) where c > 1 group by r
), b as (
  select w.r, doc_id, lang, missing, p, list_concat(h, [ascii - list_sum(h), length(t) - ascii]) as h, length(t) as chars, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(h[8] as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(n, 0) as bigint) as n_repeat_words,
    len(w) < {rules.LEAST} or 100 * coalesce(n, 0) > {rules.REPEATED} * len(w) as base_failed from w left join again using (r)
), good as (select * from b where not base_failed),
cls as (
  select lang, k, sum(h[k]) as n from good, range(1, {len(rules.NAMES) + 1}) x(k) where lang is not null group by lang, k
), clsref as (
  select lang, k, n / sum(n) over (partition by lang) as q from cls
), tok as (
  select lang, unnest(p) as word from good where lang is not null
), cnt as (
  select lang, word, count(*) as n from tok group by all
), tot as (
  select lang, sum(n) as total from cnt group by lang having sum(n) >= {rules.LEARNED}
), ref as (
  select lang, word, n / total as q from (select *, row_number() over (partition by lang order by n desc, word) as pos from cnt) join tot using (lang) where pos <= {rules.COMMON}
), most as (
  select lang, sum(q) as q, count(*) + 1 as bins from ref group by lang
), own as (
  select r, word, count(*) as c, any_value(n) as n from (select r, unnest(p) as word, len(p) as n from good) group by r, word
), hit as (
  select r, lang, sum(c / n) as p, sum(q) as q, sum({part("(c / n)", "q")}) as total from own join ref using (word) group by r, lang
), near as (
  select good.r as r, most.lang as lang, bins, case when len(good.p) = 0 then 1 else sqrt(greatest((coalesce(total, 0) + most.q - coalesce(hit.q, 0) + {part("greatest(1 - coalesce(hit.p, 0), 0)", "greatest(1 - most.q, 0)")}) / 2, 0)) end as near
  from good cross join most left join hit on hit.r = good.r and hit.lang = most.lang
), far as (
  select r, clsref.lang as lang, sqrt(greatest(sum({part("(h[k] / chars)", "q")}) / 2, 0)) as far from good join clsref on true group by r, clsref.lang
), best as (
  select r, lang, bins, far, near from near join far using (r, lang) qualify row_number() over (partition by r order by round(far + near, 11), lang) = 1
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, best.lang as ref_lang, round(far, 6) as char_distance, round(near, 6) as word_distance,
  not base_failed and not coalesce(chars >= {rules.CHARS} and far * far > {rules.CHAR_LIMIT} + {len(rules.NAMES)} / (8 * ln(2) * chars), false)
    and not coalesce(len(p) >= {rules.WORDS} and near * near > {rules.WORD_LIMIT} + bins / (8 * ln(2) * len(p)), false) as kept
from b left join best using (r)
"""


@_query("op11_quality_rules", _op11_sql())
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and whether its histograms are near enough to those of a language."""
    found = rules.scanned(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


_OP12_SQL = """
with v as (
  select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * cast(x as double)) for x in embedding] as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len([1 for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select a.row as anchor, a.vec_id as anchor_id, c.vec_id as id, a.label = c.label as same, cast(case
      when len(a.v) = len(c.v) and len(a.v) > 0 then list_dot_product(a.v, c.v)
      else coalesce(list_sum([coalesce(a.v[i], 0) * coalesce(c.v[i], 0) for i in range(1, least(len(a.v), len(c.v)) + 1)]), 0) end as bigint) as score
  from v a join v c on a.vec_id % 100 = 0 and a.row <> c.row
), p as (
  select anchor, anchor_id, id as positive_id, score as positive_score, row_number() over (partition by anchor order by score desc, id) as at_ from s where same qualify at_ <= 5
)
select p.anchor_id as anchor_id, positive_id, cast(row_number() over (partition by p.anchor, p.at_ order by score desc, id) as integer) as rank, id as negative_id, positive_score, score as negative_score
from p join s on s.anchor = p.anchor and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""


@_query("op12_hard_negatives", _OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 100, with a seventh of all labels moved."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


_OP13_SQL = """
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(octet_length(encode(role)), 0) || ':' || coalesce(role, '') || coalesce(text, ''))) as k,
    md5(coalesce(octet_length(encode(role)), 0) || ':' || coalesce(role, '') || coalesce(text, '')) as m, coalesce(octet_length(encode(text)), 0) as b from conversations where conv_id is not null
), c as (
  select conv_id, conv_id - conv_id % 5 as base, (xor(4294967295, list_reduce(list_prepend(4294967295, [cast(ascii(x) as bigint) for x in string_split(cast(conv_id as varchar), '')]),
    lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))))) % 9 as h from (select distinct conv_id from t)
), r as (
  select c.conv_id as conv_id, k, m, b from c join t on t.conv_id = c.base where k <= h
  union all
  select c.conv_id, k, m, b from c join t on t.conv_id = c.conv_id where k > h
), s as (
  select c.conv_id as conv_id, count(m) as len, coalesce(string_agg(m, '' order by k), '') as path, list(b order by k) as b from c left join r on r.conv_id = c.conv_id group by c.conv_id
), x as (
  select conv_id, len, substr(path, 1, 32 * d) as path, d, case when d = 0 then 0 else b[d] end as b from (select *, unnest(range(0, len + 1)) as d from s)
), n as (
  select path, d, min(conv_id) as conv_id, count(*) as n, any_value(b) as b, string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (len = d) as ends from x group by path, d
), kids as (
  select substr(path, 1, 32 * (d - 1)) as path, count(*) as kids from n where d > 0 group by 1
), o as (
  select n.*, coalesce(kids, 0) as kids from n left join kids using (path)
), u as (
  select substr(path, 1, 32 * k) as path, sum(case when kids = 0 then 1 else 0 end) as leaves, sum((n - 1) * b) as saved from (select *, unnest(range(0, d + 1)) as k from o) group by 1
)
select o.conv_id as conv_id, cast(o.d as bigint) as depth, p.conv_id as parent_conv_id, cast(o.n as bigint) as n_convs, cast(o.kids as bigint) as n_children, cast(leaves as bigint) as n_leaves,
  cast(saved as bigint) as saved_tokens, sha256(coalesce(o.ends, '')) as ends_sha256
from o join u using (path) left join n p on o.d > 0 and p.path = substr(o.path, 1, 32 * (o.d - 1)) and p.d = o.d - 1
"""


@_query("op13_prefix_trie", _OP13_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, each with its first turns from the one whose id is the next lower multiple of five."""
    base = F.col("conv_id") - F.col("conv_id") % 5
    rows = trie.turns(_table(spark, sf_dir, "conversations"), near=base)
    return trie.nodes(trie.spliced(rows, F.col("near"), F.crc32(F.col("id").cast("string")) % 9, 8))


@_query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _ORACLES
