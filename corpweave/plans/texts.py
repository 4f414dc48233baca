"""Text queries over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpweave.functions import text as X
from corpweave.plans.base import table
from corpweave.registry import query


def decorated() -> Column:
    """Text with boilerplate around it, in turn by doc_id."""
    parts = ["© 2020 Some Press Ltd\n", "  ;: ", "All Rights Reserved. ", "see https://a.example/x?y=1 and ", "mail x.y@z.example doi: 10.1/ab ", ""]
    at = F.array(*map(F.lit, parts))
    return F.concat(F.get(at, (F.col("doc_id") % 6).cast("int")), F.col("text"), F.lit("  “so” – it’s\t done "))


DECORATED = """(['© 2020 Some Press Ltd' || chr(10), '  ;: ', 'All Rights Reserved. ', 'see https://a.example/x?y=1 and ', 'mail x.y@z.example doi: 10.1/ab ', ''])[cast(doc_id % 6 as int) + 1] || text || '  “so” – it’s' || chr(9) || ' done '"""


def _removed(t: str, leading: bool) -> str:
    for p in (r"(?i)©\s*\d{4}[^\n]*", r"(?i)all rights reserved\.?", r"https?://\S+", r"\S+@\S+\.\S+", r"\b(doi|DOI):\s*\S+"):
        t = f"regexp_replace({t}, '{p}', ' ', 'g')"
    if leading:
        t = rf"regexp_replace({t}, '^[\s\.,;:\-]+', '')"
    return rf"regexp_replace(regexp_replace({t}, '\s{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')"


PLAIN = f"translate({DECORATED}, '‘’“”–—', '''''\"\"--')"
WORDS = r"len([w for w in regexp_split_to_array({0}, '\s+') if w <> ''])"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("scl_01_unicode_marks", f"select doc_id, md5({PLAIN}) as digest from documents")
def scl_01(spark, sf_dir):
    """SCL-01: NFKC and plain marks; the texts hold no compatibility characters, so the oracle needs the marks only."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.normalised(decorated())).alias("digest"))


@query("scl_02_boilerplate", f"select doc_id, md5({_removed(PLAIN, True)}) as digest from documents")
def scl_02(spark, sf_dir):
    """SCL-02: boilerplate strip."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.boilerplate_removed(X.plain_marks(decorated()))).alias("digest"))


@query("scl_03_boilerplate_benchmark", f"select doc_id, md5({_removed(PLAIN, False)}) as digest from documents")
def scl_03(spark, sf_dir):
    """SCL-03: boilerplate strip that keeps leading punctuation."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.boilerplate_removed(X.plain_marks(decorated()), leading=False)).alias("digest"))


PAGED = "text || chr(10) || '[page break] 12' || chr(10) || '  7  ' || chr(10) || '| 8' || chr(10) || text"


@query("scl_04_document_clean", f"""
with a as (select doc_id, regexp_replace(regexp_replace(regexp_replace(translate({PAGED}, '‘’“”–—', '''''""--'),
   '(?i)\\[PAGE BREAK\\]', chr(10) || chr(10), 'g'), '(?m)^[ \\t]*\\d+[ \\t]*$', '', 'g'), '(?m)^\\|[ \\t]*\\d+[ \\t]*$', '', 'g') as t from documents),
b as (select doc_id, string_split(t, chr(10)) as l from a),
c as (select doc_id, array_to_string([l[i] for i in range(1, len(l) + 1) if i = 1 or trim(l[i]) = '' or trim(l[i]) <> trim(l[i - 1])], chr(10)) as t from b)
select doc_id, md5(trim(regexp_replace(regexp_replace(t, '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10))) as digest from c""")
def scl_04(spark, sf_dir):
    """SCL-04 and SCL-05: page marks, page numbers, repeated lines and spaces of a document."""
    text = F.concat(F.col("text"), F.lit("\n[page break] 12\n  7  \n| 8\n"), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.document_cleaned(text)).alias("digest"))


@query("scl_05_adjacent_lines", """
with b as (select doc_id, string_split(text, chr(10)) as l from documents)
select doc_id, md5(array_to_string([l[i] for i in range(1, len(l) + 1) if i = 1 or trim(l[i]) = '' or trim(l[i]) <> trim(l[i - 1])], chr(10))) as digest from b""")
def scl_05(spark, sf_dir):
    """SCL-05: a non-blank line that equals the one before it is removed."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.lines_deduplicated(F.col("text"))).alias("digest"))


PARAGRAPHS = rf"[trim(regexp_replace(p, '\s+', ' ', 'g')) for p in case when regexp_matches(text, '\n\s*\n') then regexp_split_to_array(text, '\n\s*\n') else string_split(text, chr(10)) end]"


@query("scl_06_paragraphs", f"""
with a as (select doc_id, unnest({PARAGRAPHS}) as p from documents)
select doc_id, cast(count(*) as bigint) as n, cast(sum(length(p)) as bigint) as n_chars from a where {WORDS.format('p')} >= 20 group by doc_id""")
def scl_06(spark, sf_dir):
    """SCL-06: paragraphs of twenty words and more."""
    p = _docs(spark, sf_dir).select("doc_id", F.explode(X.paragraphs(F.col("text"))).alias("p"))
    return p.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("p")).alias("n_chars"))


@query("scl_07_word_count", f"select doc_id, cast({WORDS.format('text')} as int) as n_words from documents")
def scl_07(spark, sf_dir):
    """SCL-07: words between white space."""
    return _docs(spark, sf_dir).select("doc_id", X.word_count(F.col("text")).alias("n_words"))


@query("scl_08_title_combine", """
select conv_id, turn, md5(case when length(role) > 0 and turn % 3 > 0 then role || '. ' || text else text end) as combined, md5(role || ' ' || text) as spaced from conversations""")
def scl_08(spark, sf_dir):
    """SCL-08: title and abstract as one text, by both conventions."""
    c = table(spark, sf_dir, "conversations")
    title = F.when(F.col("turn") % 3 > 0, F.col("role")).otherwise("")
    return c.select("conv_id", "turn", F.md5(X.titled(title, F.col("text"))).alias("combined"), F.md5(X.titled(F.col("role"), F.col("text"), " ")).alias("spaced"))


@query("scl_09_top_names", """
with a as (select c_custkey, unnest([{'s': -o_totalprice, 'n': o_orderpriority}]) as x from customer join orders on c_custkey = o_custkey),
b as (select c_custkey, x.n as n, row_number() over (partition by c_custkey order by x.s, x.n) as k from a)
select c_custkey, string_agg(n, '|' order by k) as names from b where k <= 3 group by c_custkey""")
def scl_09(spark, sf_dir):
    """SCL-09: names of the three items with the highest scores out of an array of structs."""
    item = F.struct(F.col("o_orderpriority").alias("display_name"), F.col("o_totalprice").alias("score"))
    items = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(item).alias("items"))
    return items.select("c_custkey", F.array_join(X.top_names(F.col("items")), "|").alias("names"))


@query("scl_10_one_hot_labels", """
with a as (select doc_id, array_to_string([x for x in [case when quality = 1 then 1 end, case when toxic = 1 then 2 end] if x is not null], ',') as ids from labels)
select * from a where ids <> ''""")
def scl_10(spark, sf_dir):
    """SCL-10: class ids of columns equal to one; rows without any are dropped."""
    rows = table(spark, sf_dir, "labels").select("doc_id", X.labels_of({1: F.col("quality"), 2: F.col("toxic")}).alias("ids"))
    return rows.where("ids is not null").select("doc_id", F.array_join("ids", ",").alias("ids"))


@query("scl_11_label_normalise", """
select doc_id, array_to_string(list_sort(list_distinct([x for x in case when doc_id % 4 = 0 then [cast(doc_id % 5 as int)] else [cast(doc_id % 23 as int), cast(doc_id % 7 as int), 30] end if x between 1 and 17])), ',') as ids from documents""")
def scl_11(spark, sf_dir):
    """SCL-11: one sorted list of valid class ids out of a list or a single value."""
    d = F.col("doc_id")
    many = F.when(d % 4 != 0, F.array((d % 23).cast("int"), (d % 7).cast("int"), F.lit(30)))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(X.labels_normalised(many, (d % 5).cast("int")), ",").alias("ids"))


@query("scl_12_hash_id", "select page_id, substr(sha256(url), 1, 16) as id from pages")
def scl_12(spark, sf_dir):
    """SCL-12: sixteen hexadecimal digits of a URL's SHA-256."""
    return table(spark, sf_dir, "pages").select("page_id", X.hash_id(F.col("url")).alias("id"))


@query("scl_13_composite_key", """
select doc_id, 'vnr_' || concat_ws('_', translate(upper(lang), '/ -', '___'), translate(upper(source || ' a/b-c'), '/ -', '___'), case when doc_id % 2 = 0 then cast(2000 + doc_id % 20 as varchar) end) as key from documents""")
def scl_13(spark, sf_dir):
    """SCL-13: composite key with an optional year."""
    year = F.when(F.col("doc_id") % 2 == 0, (2000 + F.col("doc_id") % 20).cast("string"))
    return _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("vnr_"), F.concat_ws("_", X.key_part(F.col("lang")), X.key_part(F.concat("source", F.lit(" a/b-c"))), year)).alias("key"))


@query("scl_14_lookup", """
select source, coalesce(case source when 'src0' then 'hot' when 'src1' then 'first' when 'src2' then 'second' end, source) as family, cast(count(*) as bigint) as n from documents group by source""")
def scl_14(spark, sf_dir):
    """SCL-14: class lookup from constants; an unknown key is its own class."""
    names = F.create_map(*(F.lit(x) for kv in {"src0": "hot", "src1": "first", "src2": "second"}.items() for x in kv))
    return _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n")).select("source", F.coalesce(F.try_element_at(names, F.col("source")), F.col("source")).alias("family"), "n")


@query("scl_15_snippet", r"""
with a as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from documents)
select doc_id, case when length(t) > 220 then rtrim(substr(t, 1, 217)) || '...' else t end as snippet from a""")
def scl_15(spark, sf_dir):
    """SCL-15: one line of at most 220 characters."""
    return _docs(spark, sf_dir).select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@query("scl_16_lexical_category", r"""
with a as (select doc_id, lower(text) || (['', ' deep learning models', ' a school', ' teachers train'])[cast(doc_id % 4 as int) + 1] as t from documents),
b as (select doc_id, regexp_matches(t, '\b(?:machine learning|deep learning|reinforcement learning|supervised learning|unsupervised learning|neural network|model|models|training|trained|train|algorithm|classification|prediction)\b') as m,
  regexp_matches(t, '\b(?:education|educational|school|schools|student|students|teacher|teachers|classroom|curriculum|learning outcome|pedagogy|university|universities|course|courses|teaching)\b') as e from a)
select doc_id, case when m and e then 'both' when m then 'ml_only' when e then 'education_only' else 'neither_unclear' end as category from b""")
def scl_16(spark, sf_dir):
    """SCL-16: which of two term lists a text uses."""
    tails = F.array(*map(F.lit, ["", " deep learning models", " a school", " teachers train"]))
    t = F.concat("text", F.get(tails, (F.col("doc_id") % 4).cast("int")))
    return _docs(spark, sf_dir).select("doc_id", X.lexical_category(t).alias("category"))


@query("scl_17_usable_text", "select doc_id, len(regexp_extract_all(text, '[A-Za-z]{2,}')) >= 30 as usable from documents")
def scl_17(spark, sf_dir):
    """SCL-17: at least thirty tokens of two letters."""
    return _docs(spark, sf_dir).select("doc_id", X.usable(F.col("text")).alias("usable"))


def _rate(words: str) -> str:
    return f"case when n > 0 then round(1000.0 * len([x for x in w if {words}]) / n, 6) end"


_BE = "('am', 'is', 'are', 'was', 'were', 'be', 'been', 'being')"


@query("scl_18_linguistic_rates", f"""
with a as (select doc_id, text, regexp_extract_all(lower(text) || ' we may not be fully taken. it was seen', '[a-z]+') as w from documents),
b as (select *, len(w) as n, greatest(len(regexp_extract_all(text || ' we may not be fully taken. it was seen', '[.!?]+')), 1) as s from a)
select doc_id, {_rate("x in ('may', 'might', 'could', 'suggests', 'appears', 'potentially', 'likely')")} as hedge_rate,
  {_rate("x in ('must', 'shall', 'should', 'will')")} as deontic_rate,
  {_rate("x in ('i', 'me', 'my', 'mine', 'we', 'us', 'our', 'ours', 'ourselves')")} as first_person_rate,
  {_rate("regexp_matches(x, '^\\w+(tion|ment|ness)$')")} as nominal_rate,
  case when n > 0 then round(1000.0 * len([x for x in list_zip(w, list_concat([''], w), list_concat(['', ''], w)) if regexp_matches(x[1], 'e[dn]$') and (x[2] in {_BE} or x[2] like '%ly' and x[3] in {_BE})]) / n, 6) end as passive_proxy_rate,
  case when n > 0 then round(n / s, 6) end as mean_sentence_length from b""")
def scl_18(spark, sf_dir):
    """SCL-18: linguistic rates for each thousand words (a proxy by word forms for the passive, which needs a tagger)."""
    rows = _docs(spark, sf_dir).select("doc_id", X.linguistic_rates(F.concat("text", F.lit(" we may not be fully taken. it was seen"))).alias("r"))
    return rows.select("doc_id", *(F.round(f"r.{c}", 6).alias(c) for c in ("hedge_rate", "deontic_rate", "first_person_rate", "nominal_rate", "passive_proxy_rate", "mean_sentence_length")))


@query("scl_19_display", """
select o_orderkey, format('{:,}', cast(floor(o_totalprice + 0.5) as bigint)) as thousands,
  case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' when p < 0.10 then '+' else '' end as stars from (select *, (o_orderkey % 1000) / 5000.0 as p from orders)""")
def scl_19(spark, sf_dir):
    """SCL-19: thousands separators and marks of significance."""
    shown = F.format_number(F.floor(F.col("o_totalprice") + 0.5), 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("thousands"), X.stars((F.col("o_orderkey") % 1000) / 5000.0).alias("stars"))


@query("scl_20_signed_log", "select event_id, round(sign(value - 50) * ln(1 + abs(value - 50)), 6) as y from events")
def scl_20(spark, sf_dir):
    """SCL-20: sign(x) * log(1 + |x|)."""
    x = F.col("value") - 50
    return table(spark, sf_dir, "events").select("event_id", F.round(F.signum(x) * F.log1p(F.abs(x)), 6).alias("y"))


@query("scl_21_rounding", "select event_id, round(value / 7, 6) as half_up, round_even(cast(event_id as double) / 8, 2) as half_even from events")
def scl_21(spark, sf_dir):
    """SCL-21: rounding half up at six places, and half to even."""
    return table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") / 7, 6).alias("half_up"), F.bround(F.col("event_id").cast("double") / 8, 2).alias("half_even"))


@query("flt_01_year_range", "select cast(year(o_orderdate) as int) as y, cast(count(*) as bigint) as n from orders where year(o_orderdate) between 1993 and 1995 group by 1")
def flt_01(spark, sf_dir):
    """FLT-01: years within limits; null years go."""
    y = F.year("o_orderdate")
    return table(spark, sf_dir, "orders").where(y.between(1993, 1995)).groupBy(y.alias("y")).agg(F.count("*").alias("n"))


@query("flt_02_missing_key", """
with a as (select case when event_id % 10 = 0 then null when event_id % 10 = 1 then '' else props end as k from events)
select cast(count(*) filter (k is not null and k <> '') as bigint) as kept, cast(count(*) filter (k is null or k = '') as bigint) as dropped from a""")
def flt_02(spark, sf_dir):
    """FLT-02: rows without a key are dropped and counted."""
    k = F.when(F.col("event_id") % 10 == 0, None).when(F.col("event_id") % 10 == 1, "").otherwise(F.col("props"))
    ok = F.coalesce(F.col("k") != "", F.lit(False))
    return table(spark, sf_dir, "events").select(k.alias("k")).agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


@query("flt_03_minimum_length", f"select doc_id from documents where length(text) >= 30 and {WORDS.format('text')} >= 20")
def flt_03(spark, sf_dir):
    """FLT-03: thirty characters and twenty words at least."""
    return _docs(spark, sf_dir).where((F.length("text") >= 30) & (X.word_count(F.col("text")) >= 20)).select("doc_id")


@query("flt_04_threshold", "select l_orderkey, l_linenumber from lineitem where l_discount >= 0.05")
def flt_04(spark, sf_dir):
    """FLT-04: values below a threshold go; the filter reaches the scan."""
    return table(spark, sf_dir, "lineitem").where("l_discount >= 0.05").select("l_orderkey", "l_linenumber")


@query("flt_05_text_flag", "select o_orderkey from orders where lower(trim(' ' || o_orderstatus || ' ')) = 'f'")
def flt_05(spark, sf_dir):
    """FLT-05: a flag given as text, whatever its case and spaces."""
    return table(spark, sf_dir, "orders").where(F.lower(F.trim(F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")))) == "f").select("o_orderkey")


@query("flt_06_nested_predicate", "select doc_id, source from documents where lang = 'en'")
def flt_06(spark, sf_dir):
    """FLT-06: predicate on a nested field."""
    d = _docs(spark, sf_dir).select("doc_id", F.struct(F.col("lang").alias("language"), "source").alias("metadata"))
    return d.where("metadata.language = 'en'").select("doc_id", "metadata.source")


@query("flt_07_keywords", r"""
with a as (select doc_id, text || (['', ' the climate change', ' SDG 4 now', ' COP26 rule of law', ' SDG13'])[cast(doc_id % 5 as int) + 1] as t from documents)
select doc_id, regexp_matches(t, '(?i)\b(?:sustainable development goals?|SDG[s\s\d]|2030 agenda|climate change|rule of law|hunger|COP\s*\d+)\b') as on_topic from a""")
def flt_07(spark, sf_dir):
    """FLT-07: whether one of the topic phrases stands in a text."""
    tails = F.array(*map(F.lit, ["", " the climate change", " SDG 4 now", " COP26 rule of law", " SDG13"]))
    t = F.concat("text", F.get(tails, (F.col("doc_id") % 5).cast("int")))
    return _docs(spark, sf_dir).select("doc_id", X.on_topic(t).alias("on_topic"))


@query("flt_08_single_label", "select doc_id, lang from documents where lang in ('en', 'de') and (doc_id % 20) between 1 and 17")
def flt_08(spark, sf_dir):
    """FLT-08: exactly one valid label, and a source out of a fixed list."""
    d = _docs(spark, sf_dir).withColumn("labels", F.array((F.col("doc_id") % 20).cast("int")))
    ok = (F.size("labels") == 1) & F.get("labels", F.lit(0)).between(1, 17) & F.col("lang").isin("en", "de")
    return d.where(ok).select("doc_id", "lang")



def subsample(panel: DataFrame, name: str) -> DataFrame:
    """FLT-09: rows of a named subsample; an unknown name is an error."""
    known = {"all": "true", "english": "lang = 'en'", "long": "n_chars >= 1000", "hot": "source = 'src0'"}
    if name not in known:
        raise ValueError(f"no subsample {name}; there are {', '.join(known)}")
    return panel.where(known[name])


@query("flt_09_subsample", """
select 'all' as name, cast(count(*) as bigint) as n from documents union all select 'english', count(*) from documents where lang = 'en'
union all select 'long', count(*) from documents where n_chars >= 1000 union all select 'hot', count(*) from documents where source = 'src0'""")
def flt_09(spark, sf_dir):
    """FLT-09: sizes of all named subsamples, in one pass."""
    d = _docs(spark, sf_dir)
    names = {"all": F.lit(True), "english": F.col("lang") == "en", "long": F.col("n_chars") >= 1000, "hot": F.col("source") == "src0"}
    one = d.agg(*(F.count_if(c).alias(k) for k, c in names.items()))
    return one.unpivot([], list(names), "name", "n")


@query("flt_10_masks", "select l_returnflag, cast(count(*) as bigint) as n from lineitem where l_tax is not null and not (l_discount > 0.08) and l_linenumber <> 4 group by 1")
def flt_10(spark, sf_dir):
    """FLT-10: finite, reliable and leave-one-out masks together."""
    return table(spark, sf_dir, "lineitem").where("l_tax is not null and not (l_discount > 0.08) and l_linenumber <> 4").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("flt_11_valid_terms", r"""
with w as (select distinct unnest(regexp_extract_all(lower(text), '[^\s]+')) as term from documents)
select term from w where regexp_matches(term, '[A-Za-z]') and length(term) >= 3 and term not in ('the', 'and', 'that', 'with')""")
def flt_11(spark, sf_dir):
    """FLT-11: terms with a letter, three characters and no stop word."""
    w = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([^ \t\n\r\f]+)"), 1)).alias("term")).distinct()
    return w.where(X.valid_term(F.col("term"), ["the", "and", "that", "with"]))


def active_classes(raw: str, last: int = 17) -> list[int]:
    """FLT-12: class ids of a comma list; an id out of range is an error."""
    ids = sorted({int(x) for x in raw.split(",") if x.strip()})
    if any(not 0 <= i <= last for i in ids):
        raise ValueError(f"class ids go from 0 to {last}")
    return ids


@query("flt_12_class_subset", "select vec_id, label from embeddings where label in (1, 3, 7)")
def flt_12(spark, sf_dir):
    """FLT-12: rows of a chosen subset of classes."""
    return table(spark, sf_dir, "embeddings").where(F.col("label").isin(active_classes("1, 3,7"))).select("vec_id", "label")
