"""Registered queries of row-wise tests, lookups and small reports, beside those of `catalog`."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import agreement, incremental, kg, metrics, quality, sampling
from .catalog import DRUGS, PAIRS, RATINGS, REASONS, STRIP, TERMS, _checked, _kg, _kg_sql, _read, pairs, query, ratings

GREETING = r"hi|hello|hey|dear|sir|madam|madame|greetings|bonjour|salut"
SITE = r"i[\s-]?cliniq|icliniq|i\s+cliniq"


@query("select doc_id, coalesce(nullif(case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then lang end, ''), nullif(source, ''), '') as v from documents")
def truthy_chain(spark, d):
    first = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("lang"))
    return _read(spark, d, "documents").select("doc_id", T.truthy(first, "source").alias("v"))


@query("select doc_id, contains(source, '1') as has, not contains(source, '1') as lacks, source = 'src1' as is_it, starts_with(source, 'src1') as begins from documents")
def provenance(spark, d):
    tests = [quality.from_source(how, what).alias(name) for how, what, name in [("contains", "1", "has"), ("lacks", "1", "lacks"), ("equals", "src1", "is_it"), ("startswith", "src1", "begins")]]
    return _read(spark, d, "documents").select("doc_id", *tests)


@query(f"with {PAIRS} select pair_id from p where question <> '' and answer <> '' and specialty <> '' and language <> 'en'")
def trilingual_complete(spark, d):
    x = pairs(spark, d).withColumn("fr", F.when(F.col("language") != "en", F.col("language")))
    return x.where(quality.complete_trilingual(("question", "answer", "specialty", "fr"))).select("pair_id")


@query("select doc_id, doc_id % 3 = 0 or doc_id % 5 = 0 as usable from documents")
def source_gate(spark, d):
    x = _read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.array("source")).alias("pmids"), F.when(F.col("doc_id") % 5 == 0, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("sets"))
    return x.select("doc_id", quality.has_sources("pmids", "sets").alias("usable"))


@query(f"with {PAIRS} select pair_id, case when answer <> '' then 'done' else 'pending' end as state from p")
def split_pending(spark, d):
    done, todo = incremental.split_done(pairs(spark, d), "answer")
    return done.select("pair_id", F.lit("done").alias("state")).unionByName(todo.select("pair_id", F.lit("pending").alias("state")))


@query("select conv_id, turn, role from conversations")
def prefixed_columns(spark, d):
    x = _read(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("audio_length"), F.col("text").alias("audio_text"))
    return quality.drop_prefixed(x)


@query(f"with {PAIRS} select pair_id, length({STRIP.format('question')}) >= 40 and length({STRIP.format('answer')}) >= 80 as valid from p")
def made_valid(spark, d):
    return pairs(spark, d).select("pair_id", quality.valid_made("question", "answer").alias("valid"))


@query("select doc_id, md5(substring(text, 1, 500)) as a, md5(substring(text, 1, 4500)) as b from documents")
def truncations(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(F.substring("text", 1, 500)).alias("a"), F.md5(F.substring("text", 1, 4500)).alias("b"))


@query(f"with {PAIRS} select pair_id, case when language = 'fr' then specialty when language = 'ar' then question else substring(answer, 1, 20) end as chosen from p")
def language_column(spark, d):
    bucket = T.language_bucket("language")
    return pairs(spark, d).select("pair_id", F.when(bucket == "french", F.col("specialty")).when(bucket == "arabic", F.col("question")).otherwise(F.substring("answer", 1, 20)).alias("chosen"))


@query("select event_id, value / 100 < 0.35 or (event_id % 10) / 10.0 < 0.35 or coalesce(case when event_id % 3 = 0 then value * 20 end > 800, false) as flagged from events where value is not null")
def dialect_flags(spark, d):
    e = _read(spark, d, "events").where("value is not null").select("event_id", (F.col("value") / 100).alias("q_arabic_ratio"), ((F.col("event_id") % 10) / 10).alias("a_arabic_ratio"), F.when(F.col("event_id") % 3 == 0, F.col("value") * 20).alias("q_ppl"), F.lit(None).cast("double").alias("a_ppl"))
    return e.select("event_id", quality.dialect_flag().alias("flagged"))


@query(r"select doc_id, len(list_filter(regexp_split_to_array(text, '[.!?؟]+\s+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> ''))::bigint as n from documents")
def sentences(spark, d):
    return _read(spark, d, "documents").select("doc_id", T.sentence_count("text").cast("long").alias("n"))


@query(rf"""with x as (select doc_id, case doc_id % 3 when 0 then 'Hello, Welcome to i-cliniq.com. ' when 1 then ' bonjour bienvenue sur icliniq! ' else '' end || coalesce(text, '') as t from documents),
y as (select doc_id, regexp_replace(t, '(?i)^\s*(?:{GREETING})?\s*[!,.\s]*(?:welcome|bienvenue)\s+(?:to|sur|au|à|a)\s+(?:{SITE})(?:\.com)?\s*[.!,]?\s*', '') as t from x) select doc_id, {STRIP.format('t')} as t from y""")
def opener_strip(spark, d):
    head = F.when(F.col("doc_id") % 3 == 0, "Hello, Welcome to i-cliniq.com. ").when(F.col("doc_id") % 3 == 1, " bonjour bienvenue sur icliniq! ").otherwise("")
    return _read(spark, d, "documents").select("doc_id", T.strip_opener(F.concat(head, "text"), GREETING, SITE).alias("t"))


@query(r"""with x as (select doc_id, 'take ' || doc_id || ' mg, 2,5 ml, 5 gouttes, 5 Gouttes or 3 daily and 7 mgs' as t from documents)
select doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(t, '(?i)\b\d{1,4}(?:[.,]\d+)?\s*(?:mg|g|mcg|ml|l|gouttes?|daily)\b'), lambda x: lower(x)))) as doses from x""")
def answer_doses(spark, d):
    t = F.concat(F.lit("take "), "doc_id", F.lit(" mg, 2,5 ml, 5 gouttes, 5 Gouttes or 3 daily and 7 mgs"))
    return _read(spark, d, "documents").select("doc_id", F.array_sort(T.answer_dosages(t)).alias("doses"))


@query("""with x as (select event_id, event_type || ':m:' || user_id || ', bad, x: ,b:' || event_id as t from events), p as (select event_id, trim(unnest(string_split(t, ','))) as e from x)
select event_id, trim(substring(e, 1, strpos(e, ':') - 1)) as provider, trim(substring(e, strpos(e, ':') + 1)) as model from p where strpos(e, ':') > 1 and trim(substring(e, strpos(e, ':') + 1)) <> ''""")
def provider_chains(spark, d):
    t = F.concat("event_type", F.lit(":m:"), "user_id", F.lit(", bad, x: ,b:"), "event_id")
    return _read(spark, d, "events").select("event_id", F.inline(T.provider_chain(t)))


@query("select event_id, round(value / (value + 0.5 * (event_id % 7) + 1e-8), 6)::double as mix, round(least(value * 2, greatest(0.8, least(1.2, value)) * 2), 6)::double as gain, round(exp(1.0 - event_id % 3) - (1.0 - event_id % 3) - 1, 6)::double as kl from events where value > 0")
def policy_terms(spark, d):
    e = _read(spark, d, "events").where("value > 0")
    kl = metrics.kl_k3(F.array((F.col("event_id") % 3).cast("double")), F.array(F.lit(1.0)))
    return e.select("event_id", F.round(metrics.adaptive_mix(F.col("value"), F.col("event_id") % 7, 0.5), 6).alias("mix"), F.round(metrics.clipped_surrogate(F.col("value"), F.lit(2.0)), 6).alias("gain"), F.round(F.get(kl, F.lit(0)), 6).alias("kl"))


@query("with m as (select source, lang, avg(n_chars) as n_chars from documents group by all) select source, round(avg(n_chars), 6)::double as n_chars from m group by 1")
def language_macro(spark, d):
    per = metrics.means(_read(spark, d, "documents"), ["source", "lang"], ["n_chars"])
    return metrics.macro(per, ["source"], ["n_chars"]).withColumn("n_chars", F.round("n_chars", 6))


@query("select event_type, round(avg(value), 6)::double as mean, round(stddev_samp(value) / nullif(avg(value), 0), 6)::double as cv from events group by 1")
def robustness(spark, d):
    return metrics.variation(_read(spark, d, "events"), "event_type", "value").withColumns({"mean": F.round("mean", 6), "cv": F.round("cv", 6)})


@query("with m as (select event_type as model, 'm' || user_id % 5 as metric, count(*) as value from events group by all) select metric, max(case when model = 'click' then value end)::bigint as click, max(case when model = 'view' then value end)::bigint as view from m group by 1")
def metric_matrix(spark, d):
    m = _read(spark, d, "events").groupBy(F.col("event_type").alias("model"), F.concat(F.lit("m"), F.col("user_id") % 5).alias("metric")).agg(F.count("*").alias("value"))
    return metrics.matrix(m, ["click", "view"])


@query(f"with {RATINGS} select pair_id from r where value is not null group by 1 having count(distinct rater) = 3")
def rated_by_all(spark, d):
    return agreement.rated_by_all(ratings(spark, d).where("value is not null"), 3)


@query("select doc_id, 'note ' || doc_id as comment from labels where quality = 0 or toxic = 1")
def rejected_items(spark, d):
    x = _read(spark, d, "labels").select("doc_id", F.concat(F.lit("note "), "doc_id").alias("comment"), F.col("quality").alias("c1"), (1 - F.col("toxic")).alias("c2"), F.lit(None).cast("int").alias("c3"))
    return agreement.rejected(x).select("doc_id", "comment")


@query(f"with {REASONS}, h as (select specialty, reason, count(*)::bigint as n from c where reason <> 'ok' group by all) select specialty, reason, n from h qualify row_number() over (partition by specialty order by n desc, reason) <= 5")
def top_reasons(spark, d):
    rank = F.row_number().over(W.partitionBy("specialty").orderBy(F.desc("n"), "reason"))
    return quality.rejections(_checked(spark, d)).withColumn("r", rank).where("r <= 5").drop("r")


@query(f"with {REASONS} select count(*)::bigint as n_in, count(case when reason = 'ok' then 1 end)::bigint as n_out, round(100.0 * count(case when reason = 'ok' then 1 end) / greatest(1, count(*)), 6)::double as keep_rate from c")
def grand_total(spark, d):
    t = _checked(spark, d).agg(F.count("*").alias("n_in"), F.count_if(F.col("reason") == "ok").alias("n_out"))
    return t.withColumn("keep_rate", F.round(100 * F.col("n_out") / F.greatest(F.lit(1), F.col("n_in")), 6))


@query(f"{_kg_sql()} select distinct target as id, split_part(target, ':', 1) as type from e union select distinct source, 'drug' from b")
def kg_nodes(spark, d):
    blocks = _read(spark, d, "documents").select(F.col("source").alias("drug"))
    return kg.nodes(blocks, _kg(spark, d)).select("id", "type")


@query("select distinct lower(source) as drug from documents where length(source) >= 5")
def drug_vocabulary(spark, d):
    n = _read(spark, d, "documents").select(F.col("source").alias("label"), F.lit("drug").alias("type"))
    return kg.drug_vocabulary(n, 5)


@query("select doc_id, i as pos, case when doc_id % 2 = 0 then 'q' || i || 'r' || i end as zipped from documents, (select unnest([1, 2, 3]) as i) where doc_id % 2 = 0")
def zipped_response(spark, d):
    n = F.when(F.col("doc_id") % 2 == 0, 4).otherwise(2)
    block = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat(F.lit("q"), i))
    x = _read(spark, d, "documents").select("doc_id", block.alias("b"), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("r"), i)).alias("r"))
    z = x.select("doc_id", F.posexplode(incremental.zip_block(F.col("b"), F.col("r")))).select("doc_id", (F.col("pos") + 1).alias("pos"), F.concat(F.col("col")["b"], F.col("col")["1"]).alias("zipped"))
    return z


@query(f"with {PAIRS} select specialty, pair_id, lang from (select specialty, pair_id from p qualify row_number() over (partition by specialty order by pair_id) <= 2), (select unnest(['en', 'fr', 'darija']) as lang)")
def rows_by_language(spark, d):
    first = incremental.head(pairs(spark, d), "specialty", "pair_id", 2)
    return first.select("specialty", "pair_id", F.explode(F.array(F.lit("en"), F.lit("fr"), F.lit("darija"))).alias("lang"))


@query(f"with {PAIRS} select pair_id, case specialty when 'src0' then 'Heart' when 'src1' then 'Skin' else specialty end as label from p")
def specialty_labels(spark, d):
    labels = spark.createDataFrame([("src0", "Heart"), ("src1", "Skin")], "specialty string, label string")
    return pairs(spark, d).join(F.broadcast(labels), "specialty", "left").select("pair_id", F.coalesce("label", "specialty").alias("label"))


@query(f"with {PAIRS}, u as (select pair_id, ('0x' || substring(md5('42|' || pair_id), 1, 8))::ubigint / 4294967296.0 as u from p) select pair_id, case when u < 0.5 then 'en' when u < 0.75 then 'fr' else 'darija' end as lang from u")
def language_draw(spark, d):
    return pairs(spark, d).select("pair_id", sampling.choose({"en": 2, "fr": 1, "darija": 1}, 42, "pair_id").alias("lang"))


@query(f"with {PAIRS} select language, pair_id from p qualify row_number() over (partition by language order by md5('7|' || pair_id), pair_id) <= 5")
def qualitative_sample(spark, d):
    x = pairs(spark, d).select("language", "pair_id").withColumn("u", sampling.draw(7, "pair_id"))
    return x.withColumn("r", F.row_number().over(W.partitionBy("language").orderBy("u", "pair_id"))).where("r <= 5").select("language", "pair_id")


@query(f"with {PAIRS} select pair_id, list_filter({TERMS!r}, lambda t: contains(lower(answer), t)) as terms from p")
def terms_found(spark, d):
    return pairs(spark, d).select("pair_id", T.terms_in("answer", TERMS).alias("terms"))


@query(f"with {PAIRS} select pair_id, round(least(0.3, 0.1 * len(list_filter({DRUGS!r}, lambda t: contains(lower(answer), t) and not contains(lower(question), t)))), 6)::double as cost from p")
def introduced_penalty(spark, d):
    return pairs(spark, d).select("pair_id", F.round(metrics.penalty(T.terms_in("answer", DRUGS), T.terms_in("question", DRUGS)), 6).alias("cost"))


@query("select distinct source as specialty from documents where doc_id % 2 = 0 union select distinct source from documents where doc_id % 3 = 0")
def specialty_ids(spark, d):
    x = _read(spark, d, "documents")
    return x.where("doc_id % 2 = 0").select(F.col("source").alias("specialty")).union(x.where("doc_id % 3 = 0").select("source")).distinct()
