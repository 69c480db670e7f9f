"""Registered queries of dimensions, reports, routing, chunked work, sources, sinks and streams, beside those of `catalog`."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import dimensions as D
from ..functions import jsonfix
from ..functions import lexicons as L
from ..functions import text as T
from ..operators import agreement, enrich, incremental, kg, medical, metrics, models, sampling
from ..sources import readers, writers
from ..streaming import continuous
from .catalog import KAPPA, PAIRS, SCORED, STRIP, TURNS, _read, _scored, pairs, query, ratings, turns


def _folder(spark, name):
    """A fresh folder that driver and executors share; only local mode makes one up."""
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    return f"{d.rstrip('/')}/sparkloom/{uuid.uuid4().hex}/{name}"


def _q(text):
    return "'" + text.replace("'", "''") + "'"


_SPECS = "d as (select * from (values " + ", ".join(f"({k}, {', '.join(map(_q, row))})" for k, row in enumerate(D.specialties())) + ") x(k, specialty_id, label_en, label_fr, label_ar))"
_PROFILES = "f as (select * from (values " + ", ".join(f"({_q(p)}, {_q(s)})" for p, specs in D.profiles() for s in specs) + ") x(profile, specialty))"


def _by_specialty(spark, d):
    """Documents under the specialties of the dimension, by id."""
    names = F.array(*(F.lit(row[0]) for row in D.specialties()))
    return _read(spark, d, "documents").select("doc_id", "lang", F.get(names, (F.col("doc_id") % len(D.specialties())).cast("int")).alias("specialty_id"))


@query(f"with {_SPECS} select doc_id, specialty_id, label_en, label_fr, label_ar from documents join d on doc_id % 70 = k")
def specialty_dimension(spark, d):
    return _by_specialty(spark, d).join(F.broadcast(readers.specialties(spark)), "specialty_id").drop("lang")


_PACKETS = f"""{_SPECS}, {_PROFILES}, x as (select profile, specialty, doc_id, lang = 'fr' as real from documents join d on doc_id % 70 = k join f on specialty = specialty_id),
y as (select *, count_if(real) over (partition by profile, specialty) as r, count_if(not real) over (partition by profile, specialty) as s,
 row_number() over (partition by profile, specialty, real order by md5('42|' || doc_id), doc_id) as k from x),
z as (select *, least(25 - least(12, r), s) as ns from y),
p as (select profile, specialty, doc_id from z where k <= case when real then (case when 25 - least(12, r) > s then least(25 - ns, r) else least(12, r) end) else ns end)"""


def _packets(spark, d):
    specs = readers.profiles(spark).select("profile", F.explode("specs").alias("specialty"))
    rows = _by_specialty(spark, d).withColumnRenamed("specialty_id", "specialty").join(F.broadcast(specs), "specialty").withColumn("__g", F.struct("profile", "specialty"))
    return sampling.half_real(rows, "__g", F.col("lang") == "fr", "doc_id", 25).select("profile", "specialty", "doc_id")


@query(f"with {_PACKETS} select profile, specialty, doc_id from p")
def profile_packets(spark, d):
    return _packets(spark, d)


@query(f"with {_PACKETS} select count(distinct specialty)::bigint as specialties, count(distinct doc_id)::bigint as indexed, count(*)::bigint as items from p")
def coverage_counts(spark, d):
    return _packets(spark, d).agg(F.countDistinct("specialty").alias("specialties"), F.countDistinct("doc_id").alias("indexed"), F.count("*").alias("items"))


@query("""with x as (select source as specialty, count(*) as n, count_if(quality = 1) as c1, count_if(toxic = 0) as c2, count_if(lang = 'en') as c3, count_if(quality = 0 or toxic = 1 or lang <> 'en') as bad from labels join documents using (doc_id) group by 1)
select specialty, n::bigint as n, round(100.0 * c1 / n, 6)::double as c1_pct, round(100.0 * c2 / n, 6)::double as c2_pct, round(100.0 * c3 / n, 6)::double as c3_pct, round(100.0 * bad / n, 6)::double as rejected_pct from x""")
def acceptance_rates(spark, d):
    x = _read(spark, d, "labels").join(_read(spark, d, "documents"), "doc_id")
    items = x.select(F.col("source").alias("specialty"), F.lit("made").alias("source"), F.col("quality").alias("c1"), (1 - F.col("toxic")).alias("c2"), (F.col("lang") == "en").cast("int").alias("c3"))
    return agreement.rates(agreement.acceptance(items)).select("specialty", "n", *(F.round(f"{c}_pct", 6).alias(f"{c}_pct") for c in ("c1", "c2", "c3", "rejected")))


@query(f"with {KAPPA}, m as (select criterion, round(avg(round(kappa, 3)), 3) as k from kk group by 1) select round(avg(k), 3)::double as mean_kappa, avg(k) >= 0.65 as passed from m")
def kappa_overall(spark, d):
    return agreement.overall(agreement.summary(agreement.pairwise(ratings(spark, d))))


_COUNTED = SCORED.replace("s as (select conv_id, turn,", "s as (select conv_id, turn, pred_d, pred_s, pred_e, ref_d, ref_s, ref_e,")
_SHARE = lambda k: f"round(coalesce(avg(len(list_intersect(pred_{k}, ref_{k}))::double / nullif(len(ref_{k}), 0)), 0), 6)::double"
_MORE = lambda k: f"round(coalesce(avg(coalesce((len(pred_{k}) - len(list_intersect(pred_{k}, ref_{k})))::double / nullif(len(pred_{k}), 0), 0)), 0), 6)::double"


@query(f"""with {_COUNTED} select count(*)::bigint as n, {_SHARE('d')} as recall_drugs, {_SHARE('s')} as recall_symptoms, {_SHARE('e')} as recall_exams, round(avg(recall), 6)::double as recall_macro,
{_MORE('d')} as hallu_drugs, {_MORE('s')} as hallu_symptoms, {_MORE('e')} as hallu_exams, round(avg(case when conv_id % 2 = 0 then 1.0 else 0.0 end), 6)::double as hallu_dosages,
round(avg(hallucination + case when conv_id % 2 = 0 then 0.25 else 0 end), 6)::double as hallu_macro, round(avg(case when turn > 2 then 1.0 when turn > 1 then 0.0 end), 6)::double as hit_at_k,
round(avg((conv_id % 3 = 0)::int), 6)::double as citations_share, count_if(conv_id % 2 = 0)::bigint as n_dosage_hallu from s""")
def medical_macro(spark, d):
    s = _scored(spark, d)
    dosed = F.col("conv_id") % 2 == 0  # every other answer names a dosage that its reference lacks
    p = F.col("p").withField("dosages", F.when(dosed, F.array(F.lit("5 mg"))).otherwise(F.col("p.dosages")))
    s = s.withColumn("p", p).withColumns({"rec": medical.recall("p", "r"), "hal": medical.hallucination("p", "r"), "hit": F.when(F.col("turn") > 2, 1).when(F.col("turn") > 1, 0), "cites": F.col("conv_id") % 3 == 0})
    out = medical.aggregate(s)
    return out.select(*(F.col(c) if kind == "bigint" else F.round(c, 6).alias(c) for c, kind in out.dtypes))


@query(f"""with {PAIRS}, k as (select pair_id, case when pair_id % 3 <> 0 and pair_id <> 0 then pair_id::varchar else question end as key from p)
select pair_id from k where key not in (select key from k where pair_id % 4 = 0)""")
def resume_either_key(spark, d):
    p = pairs(spark, d).withColumn("own", F.when(F.col("pair_id") % 3 != 0, F.col("pair_id")))
    key = incremental.pair_key("own", "question")
    done = p.where("pair_id % 4 = 0").select(key.alias("k")).distinct()
    return p.withColumn("k", key).join(done, "k", "left_anti").select("pair_id")


@query(f"""with {PAIRS}, r as (select pair_id // 5 as batch, case when pair_id % 10 < 5 then pair_id % 5 else 4 - pair_id % 5 end as id, question as fr, case when pair_id % 4 <> 0 then specialty end as da from p where pair_id % 10 < 5 or pair_id % 3 <> 0)
select pair_id, coalesce(fr, 'kept') as fr, coalesce(da, '') as da from p left join r on pair_id // 5 = batch and pair_id % 5 = id""")
def response_positions(spark, d):
    """Responses of even batches have no ids and count by position; those of odd batches come in reverse with their ids, and some are missing."""
    p = pairs(spark, d).select("pair_id", F.floor(F.col("pair_id") / 5).alias("batch"), (F.col("pair_id") % 5).alias("at"), "question", "specialty")
    plain = F.col("batch") % 2 == 0
    item = F.struct(F.col("at").alias("order"), F.when(~plain, 4 - F.col("at")).alias("id"), F.col("question").alias("fr"), F.when(F.col("pair_id") % 4 != 0, F.col("specialty")).alias("da"))
    # a missing position is a null item, so that those after it keep theirs
    gaps = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.get(F.filter("items", lambda x: x["order"] == k.cast("long")), F.lit(0)))
    items = p.where(plain | (F.col("pair_id") % 3 != 0)).groupBy("batch").agg(F.collect_list(item).alias("items"))
    items = items.select("batch", gaps.alias("items")).withColumn("items", F.transform("items", lambda x: F.when(x.isNotNull(), x)))
    rows = p.select("pair_id", "batch", "at", F.lit("kept").alias("fr"))
    return incremental.answered(rows, "batch", "at", items, ["fr", "da"], keep=["fr"]).select("pair_id", "fr", "da")


@query(f"with {PAIRS} select pair_id, specialty from p where specialty in ('src1', 'src3')")
def allow_list(spark, d):
    return incremental.allowed(pairs(spark, d), "specialty", ["src1", "src3"]).select("pair_id", "specialty")


@query("with m as (select distinct event_type as model from events), p as (select unnest(['What is it?', 'How is it treated?', 'When to call a doctor?']) as prompt) select model, prompt from m, p")
def model_prompts(spark, d):
    prompts = spark.createDataFrame([("What is it?",), ("How is it treated?",), ("When to call a doctor?",)], "prompt string")
    return metrics.demo_runs(_read(spark, d, "events").select(F.col("event_type").alias("model")).distinct(), prompts)


@query("select doc_id, 'drug:' || source as source, 'language:' || lang as target from documents")
def edge_endpoints(spark, d):
    return _read(spark, d, "documents").select("doc_id", kg.endpoint(F.lit("drug"), "source").alias("source"), kg.endpoint(F.lit("language"), "lang").alias("target"))


_KEYS = ", ".join(_q(k) for k in jsonfix.THINK_KEYS)


@query(f"with x as (select doc_id, {STRIP.format('text')} as t from documents) select doc_id, nullif(t, '') as think, case when t = '' or t is null then 'empty_think' else '' end as reason from x")
def think_keys(spark, d):
    """Each key in turn holds the text, with a later key beside it that mustn't win."""
    keys = F.array(*(F.lit(k) for k in jsonfix.THINK_KEYS))
    key = F.get(keys, (F.col("doc_id") % 6).cast("int"))
    later = F.get(keys, (F.col("doc_id") % 6 + 1).cast("int"))
    beside = F.when(later.isNotNull() & (F.length(T.strip("text")) > 0), F.create_map(later, F.lit("beside"))).otherwise(F.create_map().cast("map<string,string>"))
    raw = F.to_json(F.map_concat(beside, F.create_map(key, F.coalesce("text", F.lit("")))))
    return _read(spark, d, "documents").select("doc_id", jsonfix.think(raw).alias("t")).select("doc_id", "t.think", "t.reason")


@query(r"""with x as (select doc_id, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1 ', 'g') as t from documents) select doc_id, md5(lower(coalesce(t, ''))) as k from x""")
def chunk_roundtrip(spark, d):
    docs = _read(spark, d, "documents")
    done = enrich.by_chunks(docs, "doc_id", "text", 4500, lambda c: c.select("request_id", F.lower("text").alias("content")))
    return done.select("doc_id", F.md5("result").alias("k"))


@query(r"""with s as (select doc_id, list_filter(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)), lambda x: x <> '') as s from documents),
h as (select doc_id, flatten(list_transform(s, lambda x: list_transform(range(0, (length(x) - 1) // 350 + 1), lambda i: substring(x, i * 350 + 1, 350)))) as s from s where len(s) > 0),
c as (select doc_id, string_split(list_reduce(s, lambda a, x: case when length(split_part(a, chr(1), -1)) + 1 + length(x) <= 350 then a || ' ' || x else a || chr(1) || x end), chr(1)) as c from h)
select doc_id, unnest(range(0, len(c)))::int as pos, unnest(c) as chunk from c""")
def chunker(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.posexplode(T.chunks("text", 350, hard=True)).alias("pos", "chunk"))


def _router():
    providers = [enrich.Stub("first", "1:", ["rein"], "empty"), enrich.Stub("second", "2:", ["rash"], "empty"), enrich.Stub("third", "3:", ["echo"], "empty")]
    return enrich.Router(providers, passes=1, sleep=lambda s: None)


@query(f"""with {PAIRS}, c as (select pair_id, answer, case when answer = '' then null when not contains(answer, 'rein') then 0 when not contains(answer, 'rash') then 1 when not contains(answer, 'echo') then 2 end as k from p)
select pair_id, case k when 0 then 'first' when 1 then 'second' when 2 then 'third' end as provider, md5((k + 1) || ':' || answer) as content from c where k is not null""")
def routed_calls(spark, d):
    p = pairs(spark, d).where("answer <> ''")
    done = enrich.first_success(enrich.routed(p, "pair_id", "answer", _router))
    return done.select(F.col("request_id").alias("pair_id"), "provider", F.md5("content").alias("content"))


@query(f"""with {PAIRS}, x as (select pair_id, answer, pair_id % 3 <> 0 as open, contains(answer, 'rein') as lost, length(answer) >= 500 as long, contains(answer, 'the') as said from p)
select pair_id, case when open and not lost and long and said then md5('t:' || answer) end as think,
case when not open then 'no_enrichment_sources_available' when lost then 'llm_failed' else concat_ws(',', case when not long then 'too_short' end, case when not said then 'off_topic' end) end as reasons from x""")
def reasoned_answers(spark, d):
    """The worker's rows with stub sources and a stub provider: gated, asked, validated."""
    x = pairs(spark, d).select("pair_id", "answer", F.col("answer").alias("message"), F.when(F.col("pair_id") % 3 != 0, F.array(F.lit("pmid"))).alias("sources"))
    ask = lambda rows: enrich.first_success(enrich.routed(rows, "pair_id", "message", lambda: enrich.Router([enrich.Stub("one", "t:", ["rein"], "empty")], passes=1)))
    checks = {"too_short": F.length("answer") >= 500, "off_topic": F.contains("answer", F.lit("the"))}
    out = enrich.answer_fields(x, ["answer"], F.size("sources") > 0, ask, checks, id_col="pair_id")
    return out.select("pair_id", F.md5("think").alias("think"), F.concat_ws(",", "reasons").alias("reasons"))


@query(f"""with {TURNS}, w as (select conv_id, turn, regexp_extract_all(lower(pred), '[\\p{{L}}\\p{{N}}_]+') as a, regexp_extract_all(lower(ref), '[\\p{{L}}\\p{{N}}_]+') as b from t),
m as (select *, coalesce(list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0) as shared from w)
select conv_id, turn, round(shared / greatest(1, len(a)), 6)::double as precision, round(shared / greatest(1, len(b)), 6)::double as recall, round(case when shared = 0 then 0 else 2 * shared / (len(a) + len(b)) end, 6)::double as f1 from m""")
def similarity_scores(spark, d):
    t = turns(spark, d).withColumn("lang", F.lit("darija"))
    s = models.pair_scores(t, "pred", "ref", "lang", keep=["conv_id", "turn"])
    return s.select("conv_id", "turn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(r"""with w as (select conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from conversations)
select conv_id, turn, case when len(w) >= 4 then round(exp(list_avg(list_transform(w[1:64], lambda x: ln(len(w)::double / len(list_filter(w, lambda y: y = x)))))), 4)::double end as ppl from w""")
def perplexity(spark, d):
    rows = _read(spark, d, "conversations").withColumn("id", F.struct("conv_id", "turn")).select(F.to_json("id").alias("id"), "text")
    s = models.token_losses(rows, "id", "text")
    x = F.from_json("id", "conv_id bigint, turn bigint")
    return s.select(x["conv_id"].alias("conv_id"), x["turn"].alias("turn"), F.round(enrich.pseudo_perplexity(F.col("losses")), 4).alias("ppl"))


@query(f"with {PAIRS} select specialty as specialty_id, pair_id, md5(question) as q, md5(answer) as a from p")
def json_array_files(spark, d):
    """Written as one JSON array for each specialty, read back."""
    path = _folder(spark, "arrays")
    writers.json_arrays(pairs(spark, d).select("pair_id", "question", "answer", F.col("specialty").alias("specialty_id")), path, order="pair_id")
    back = spark.read.schema("pair_id bigint, question string, answer string, specialty_id string").option("multiLine", True).json(path)
    return back.select("specialty_id", "pair_id", F.md5("question").alias("q"), F.md5("answer").alias("a"))


@query(f"with {PAIRS} select pair_id, case when pair_id % 3 = 0 then 'new' else 'old' end as state, md5(question) as q from p")
def checkpoint_log(spark, d):
    """Two appends to a log of JSON lines; the last row of each key counts."""
    path = _folder(spark, "log")
    p = pairs(spark, d).select(F.col("pair_id").cast("string").alias("_pair_key"), "question")
    writers.append_log(p.withColumn("state", F.lit("old")), path)
    writers.append_log(p.where("_pair_key % 3 = 0").withColumn("state", F.lit("new")), path)
    log = readers.checkpoint(spark, path, "_pair_key string, question string, state string")
    return log.select(F.col("_pair_key").cast("long").alias("pair_id"), "state", F.md5("question").alias("q"))


@query("select doc_id, case when doc_id % 3 = 0 then 0 else 1 end as c1, case when doc_id % 2 = 0 then 1 else -1 end as c2, 'note ' || doc_id as comment from documents")
def annotator_files(spark, d):
    """CSV packets as raters hand them in, read by prefix of the column names."""
    path = _folder(spark, "packets")
    x = _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("pair_id"), F.when(F.col("doc_id") % 3 == 0, "0").otherwise(" 1").alias("C1_plausibility"), F.when(F.col("doc_id") % 2 == 0, "1").otherwise("").alias("C2_x"), F.concat(F.lit("note "), "doc_id").alias("comment"))
    x.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return readers.annotations(spark, path, ("C1", "C2"), rater="r").select(F.col("pair_id").cast("long").alias("doc_id"), "c1", F.coalesce("c2", F.lit(-1)).alias("c2"), "comment")


@query("select source, lang, doc_id from documents")
def replaced_partitions(spark, d):
    """Partitions are replaced one by one: a second write of a source leaves the others alone."""
    path = _folder(spark, "parts")
    x = _read(spark, d, "documents").select("source", "doc_id", "lang")
    x.withColumn("lang", F.when(F.col("source") == "src1", "old").otherwise(F.col("lang"))).write.partitionBy("source").parquet(path)
    writers.replace_partitions(x.where("source = 'src1'"), path, "source")
    return spark.read.parquet(path).select("source", "lang", "doc_id")


@query("select doc_id, n_chars % 2 = 0 as good from documents")
def stream_increments(spark, d):
    """Two files worked off as a stream, the second with rows of the first again, and a replay of its last batch."""
    base = _folder(spark, "stream")
    x = _read(spark, d, "documents").select("doc_id", "n_chars")
    x.where("doc_id % 2 = 0").coalesce(1).write.parquet(f"{base}/in/a")
    run = lambda: continuous.resume(spark, f"{base}/in/*", "doc_id bigint, n_chars bigint", f"{base}/out", f"{base}/state", "doc_id", lambda df: df, F.col("n_chars") % 2 == 0).awaitTermination()
    run()
    x.where("doc_id % 2 = 1 or n_chars % 2 = 0").coalesce(1).write.parquet(f"{base}/in/b")
    run()
    good, bad = (spark.read.parquet(f"{base}/out/{k}").select("doc_id", F.lit(v).alias("good")) for k, v in (("accepted", True), ("rejected", False)))
    return good.union(bad)


@query("select source || '.txt' as file_name, i as ord, 'DRUG' || chr(64 + i) as drug from (select distinct source from documents), (select unnest([1, 2, 3]) as i)")
def monograph_segments(spark, d):
    """Pages with three headers and two that open nothing."""
    page = "AVERTISSEMENT\nDRUGA\nof {0}\nINDEX\nstill A\nDRUGB\n\nDRUGC\nend"
    x = _read(spark, d, "documents").select("source").distinct().select(F.concat("source", F.lit(".txt")).alias("file_name"), F.replace(F.lit(page), F.lit("{0}"), F.col("source")).alias("value"))
    return kg.segments(x).select("file_name", (F.col("ord") + 1).cast("int").alias("ord"), "drug")
