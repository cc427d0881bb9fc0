"""One query per operator over the given tables. Each takes ``(spark, sf_dir)`` and returns a DataFrame.

Row order is the primary key of the table. Nothing is sampled or cut except where that is the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.config import ScanConfig, apply_mappings, scan_prefix, validate_config
from matchloom.functions.text import (
    blank_missing,
    char_wb_ngrams,
    clean_key,
    combine,
    display_value,
    round_score,
    row_context,
    score_band,
    token_sort_form,
)
from matchloom.operators import fuzzy, keys, master, matches, report, review, tfidf
from matchloom.plans import jobs
from matchloom.plans.scratch import materialise, scratch_path
from matchloom.plans.ship import ship
from matchloom.sources import session, tables

PART_COLS = ("p_name", "p_brand")
MAPPINGS = (("p_name", "m_name"), ("p_type", "m_type"))
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part")


def gappy_parts(spark, sf_dir) -> DataFrame:
    """Parts with missing cells, the text nan, and names of punctuation only."""
    size = F.col("p_size")
    return parts(spark, sf_dir).select(
        "p_partkey",
        F.when(size % 5 == 0, "nan").when(size % 5 == 1, "---").when(size % 5 == 2, "- -").otherwise(F.col("p_name")).alias("name"),
        F.when(size % 7 != 0, size).alias("size"),
        F.when(size % 3 != 0, F.col("p_retailprice")).alias("price"),
        F.when(size % 5 > 2, F.concat(F.lit(" \t"), "p_brand", F.lit(",Inc. \n"))).alias("brand"),
    )


def master_parts(spark, sf_dir) -> DataFrame:
    """The part list as another system would write it: words swapped, other column names."""
    word = F.split("p_name", " ")
    return parts(spark, sf_dir).select(
        F.col("p_partkey").alias("m_id"),
        F.concat(word[1], F.lit(", "), F.upper(word[0])).alias("m_name"),
        F.col("p_type").alias("m_type"),
        F.col("p_brand").alias("m_brand"),
    )


def part_rows(spark, sf_dir, cols=PART_COLS) -> DataFrame:
    return keys.keyed(parts(spark, sf_dir), cols, "p_partkey")


def part_keys(spark, sf_dir, cols=PART_COLS) -> DataFrame:
    return keys.distinct_keys(part_rows(spark, sf_dir, cols))


def master_keys(spark, sf_dir) -> DataFrame:
    return keys.distinct_keys(keys.keyed(master_parts(spark, sf_dir), ("m_name", "m_type"), "m_id"))


def scored(pairs: DataFrame) -> DataFrame:
    return pairs.select("pos_a", "pos_b", round_score(F.col("raw")).alias("score"), "rank")


def part_matches(spark, sf_dir, k: int = 5) -> DataFrame:
    return jobs.dedupe(parts(spark, sf_dir), PART_COLS, k=k, order_col="p_partkey", id_col="p_partkey")


def decision_log(spark, sf_dir, by_type: bool) -> DataFrame:
    """The events table as a review log; seq leaves gaps, as a log of several users would."""
    choice = F.element_at(F.array(*[F.lit(c) for c in "ABFSU"]), (F.col("user_id") % 5 + 1).cast("int"))
    name = F.col("event_type") if by_type else F.lit("all")
    return table(spark, sf_dir, "events").select(
        name.alias("session"),
        (F.col("event_id") * 20).alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        choice.alias("choice"),
        F.concat(F.lit("  "), "props", F.lit("\t")).alias("note"),
    )


def stored_matches(spark, sf_dir, k: int = 5) -> DataFrame:
    return materialise(part_matches(spark, sf_dir, k), "matches")


def reviewed(spark, sf_dir, k: int = 5):
    found = stored_matches(spark, sf_dir, k)
    return found, jobs.review(found, decision_log(spark, sf_dir, False), False, "p_partkey")


# --- sources, sinks, sampling -----------------------------------------------------------------------


@query
def read_table(spark, sf_dir):
    path = scratch_path(spark, "parts-csv")
    gappy = gappy_parts(spark, sf_dir).select("p_partkey", "name", "size", "price")
    gappy.write.option("header", True).option("escape", '"').csv(path)
    back = tables.read_table(spark, path)
    return back.withColumns({n: F.coalesce(n, F.lit(-1).cast(back.schema[n].dataType)) for n in ("size", "price")})


@query
def normalise_missing(spark, sf_dir):
    kind = F.col("event_type")
    cells = table(spark, sf_dir, "events").select(
        "event_id", F.when(kind == "error", "N/A").when(kind == "click", "").when(kind == "view", "null").otherwise(kind).alias("kind")
    )
    return tables.normalise_missing(cells)


@query
def read_columns(spark, sf_dir):
    names = tables.read_columns(spark, f"{sf_dir}/part.parquet", "parquet")
    return parts(spark, sf_dir).agg(*[F.count(n).alias(n) for n in names])


@query
def with_row_order(spark, sf_dir):
    return keys.with_row_order(table(spark, sf_dir, "customer"), "c_custkey").select("c_name", F.col(keys.RID).alias("rid"))


@query
def head_sample(spark, sf_dir):
    return keys.head_sample(keys.with_row_order(parts(spark, sf_dir), "p_partkey")).select("p_partkey", "p_name")


@query
def export_matches(spark, sf_dir):
    path = tables.export_matches(part_matches(spark, sf_dir), scratch_path(spark, "export"), "part", False, "parquet")
    return spark.read.parquet(path)


@query
def export_decisions(spark, sf_dir):
    folder = scratch_path(spark, "final")
    _, done = reviewed(spark, sf_dir)
    files = tables.export_decisions(done.records, folder, "part", False, "parquet")
    parts_of = [spark.read.parquet(path).withColumn("sheet", F.lit(name)) for name, path in files.items()]
    return parts_of[0].unionByName(parts_of[1]) if len(parts_of) > 1 else parts_of[0]


@query
def save_and_load_session(spark, sf_dir):
    path = scratch_path(spark, "session")
    session.save_session(path, part_matches(spark, sf_dir), False, (), "p_partkey")
    session.append_events(path, decision_log(spark, sf_dir, False))
    back = session.load_session(spark, path)
    return back.matches.select(F.lit("match").alias("kind"), F.col("match_id").alias("n"), F.col("match_a").alias("text")).unionAll(
        back.events.select(F.lit("event"), "seq", "choice")
    )


@query
def scan_settings(spark, sf_dir):
    cfg = validate_config(parts(spark, sf_dir), None, ScanConfig(primary_cols=PART_COLS, file="part.parquet"))
    row = tables.scan_settings(spark, cfg, False).first()
    shown = [F.lit(row[c]).alias(c) for c in ("file", "engine", "cutoff", "max_limit", "mode", "test_mode")]
    columns = F.lit(",".join(row["primary_cols"])).alias("primary_cols")
    return parts(spark, sf_dir).agg(F.count("*").alias("n_rows")).select(*shown, columns, "n_rows")


@query
def audit_trail(spark, sf_dir):
    found = stored_matches(spark, sf_dir)
    replayed = review.in_range(review.replay_index(decision_log(spark, sf_dir, True)), found.count())
    return review.audit_trail(found, replayed)


# --- projections and filters ------------------------------------------------------------------------


@query
def blank_missing_cells(spark, sf_dir):
    df = gappy_parts(spark, sf_dir)
    return df.select("p_partkey", *[blank_missing(F.col(n), df.schema[n].dataType).alias(n) for n in ("name", "size", "price")])


@query
def combine_cols(spark, sf_dir):
    df = gappy_parts(spark, sf_dir)
    return df.select("p_partkey", combine(df.schema, ("name", "size", "price")).alias("combined"))


@query
def clean_keys(spark, sf_dir):
    df = gappy_parts(spark, sf_dir)
    return df.select("p_partkey", clean_key(df.schema, ("brand", "name", "price")).alias("key"))


@query
def clean_documents(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    key = clean_key(df.schema, ("text", "lang"))
    return df.select("doc_id", F.length(key).alias("n"), F.md5(key).alias("digest"))


@query
def drop_empty(spark, sf_dir):
    df = gappy_parts(spark, sf_dir)
    kept = keys.keyed(df, ("name",), "p_partkey")
    return kept.select("p_partkey", F.col(keys.KEY).alias("key"))


@query
def display_values(spark, sf_dir):
    df = gappy_parts(spark, sf_dir)
    rows = df.select("p_partkey", F.struct("name", "size", "price").alias("row"))
    return rows.select("p_partkey", display_value("row", rows.schema["row"].dataType, ("name", "price", "size")).alias("shown"))


@query
def row_contexts(spark, sf_dir):
    rows = gappy_parts(spark, sf_dir).select("p_partkey", F.struct("p_partkey", "name", "size", "price").alias("row"))
    return rows.select("p_partkey", row_context("row", rows.schema["row"].dataType).alias("context"))


@query
def apply_column_mappings(spark, sf_dir):
    cfg = apply_mappings(ScanConfig(primary_cols=("p_brand",), master_cols=("m_brand",), mappings=MAPPINGS))
    a = keys.keyed(parts(spark, sf_dir), cfg.primary_cols, "p_partkey").select(F.lit("primary").alias("side"), F.col(keys.RID).alias("rid"), F.col(keys.KEY).alias("key"))
    b = keys.keyed(master_parts(spark, sf_dir), cfg.master_cols, "m_id").select(F.lit("master"), keys.RID, keys.KEY)
    return a.unionAll(b)


@query
def round_scores(spark, sf_dir):
    """Scores in steps of a twentieth, so that every second one is a rounding tie."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 1001 / 10.0 * 0.5 + 25.25).alias("raw"))
    return line.select("l_orderkey", "l_linenumber", round_score(F.col("raw")).alias("score"))


@query
def above_cutoff(spark, sf_dir):
    """The cutoff is inclusive and sees unrounded scores; at 100 only reordered texts pass."""
    pairs = fuzzy.fuzzy_join(part_keys(spark, sf_dir, ("p_name", "p_type")), master_keys(spark, sf_dir), 100, 1)
    return pairs.select("pos_a", "pos_b", "raw")


@query
def score_bands(spark, sf_dir):
    found = part_matches(spark, sf_dir)
    return found.groupBy(score_band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


@query
def prefix_rows(spark, sf_dir):
    found = part_matches(spark, sf_dir)
    return found.select("match_id", *matches.prefix_rows(found))


@query
def project_ids(spark, sf_dir):
    found = part_matches(spark, sf_dir)
    return found.select("match_id", *matches.project_ids(found, False, "p_partkey"))


@query
def trim_notes(spark, sf_dir):
    return decision_log(spark, sf_dir, False).select("seq", review.trim_note(F.col("note")).alias("note"))


@query
def mode_labels(spark, sf_dir):
    found = part_matches(spark, sf_dir)
    labels = scan_prefix(False)
    return found.groupBy(*[F.lit(v).alias(k) for k, v in labels.items()]).agg(F.count("*").alias("n"))


@query
def match_context(spark, sf_dir):
    return matches.with_context(part_matches(spark, sf_dir)).select("match_id", "context_a", "context_b")


# --- scorers ----------------------------------------------------------------------------------------


@query
def token_sort_forms(spark, sf_dir):
    return part_keys(spark, sf_dir).select("pos", token_sort_form(F.col("key")).alias("form"))


@query
def token_sort_ratio(spark, sf_dir):
    p = parts(spark, sf_dir)
    text = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), text.alias("other"))
    joined = p.select("p_partkey", text.alias("text")).join(nxt, "p_partkey")
    return joined.select("p_partkey", fuzzy.token_sort_ratio(F.col("text"), F.col("other")).alias("ratio"))


@query
def char_ngrams(spark, sf_dir):
    grams = part_keys(spark, sf_dir).select("pos", F.explode(char_wb_ngrams(F.col("key"))).alias("gram"))
    return grams.groupBy("pos", "gram").agg(F.count("*").alias("n"))


@query
def tfidf_weights(spark, sf_dir):
    w = tfidf.tfidf_weights(tfidf.idf_corpus(part_keys(spark, sf_dir)))
    return w.select("pos", "gram", "tf", "df", F.round("weight", 9).alias("weight"))


@query
def cosine(spark, sf_dir):
    """Cosine of every primary key with its best master key, by the weights of both."""
    pairs = tfidf.tfidf_join(part_keys(spark, sf_dir, ("p_name", "p_type")), master_keys(spark, sf_dir), 50, 1)
    return pairs.select("pos_a", "pos_b", F.round(F.col("raw") / 100, 8).alias("cosine"))


@query
def field_scores(spark, sf_dir):
    found = part_matches(spark, sf_dir)
    pairs = (("p_name", "p_name"), ("p_type", "p_brand"), ("p_retailprice", "p_size"), ("p_name", "p_unknown"))
    scores = matches.field_scores(found, pairs)
    return scores.select("match_id", "field", "p_col", "m_col", "val_a", "val_b", F.round("field_score", 9).alias("field_score"))


# --- joins and top k --------------------------------------------------------------------------------


@query
def fuzzy_dedupe(spark, sf_dir):
    return scored(fuzzy.fuzzy_self_join(part_keys(spark, sf_dir), 85, 5))


@query
def fuzzy_dedupe_by_signatures(spark, sf_dir):
    return scored(fuzzy.fuzzy_self_join(part_keys(spark, sf_dir, (*PART_COLS, "p_type")), 90, 3, "signatures"))


@query
def fuzzy_dedupe_by_pivots(spark, sf_dir):
    return scored(fuzzy.fuzzy_self_join(part_keys(spark, sf_dir, (*PART_COLS, "p_type")), 85, 5, "metric"))


@query
def fuzzy_master_by_pivots(spark, sf_dir):
    return scored(fuzzy.fuzzy_join(part_keys(spark, sf_dir, ("p_name", "p_type")), master_keys(spark, sf_dir), 85, 5, "metric"))


@query
def fuzzy_master_indexed(spark, sf_dir):
    """The master is stored by the blocks of its pivots, once; only the primary side moves."""
    index = master.build_master_index(master_keys(spark, sf_dir))
    return scored(master.map_to_index(part_keys(spark, sf_dir, ("p_name", "p_type")), index, 85, 5))


@query
def fuzzy_master(spark, sf_dir):
    return scored(fuzzy.fuzzy_join(part_keys(spark, sf_dir, ("p_name", "p_type")), master_keys(spark, sf_dir), 85, 5))


@query
def fuzzy_customers_to_suppliers(spark, sf_dir):
    """Names of one digit pattern: nearly all scores tie, so the order of ties decides."""
    a = keys.distinct_keys(keys.keyed(table(spark, sf_dir, "customer"), ("c_name",), "c_custkey"))
    b = keys.distinct_keys(keys.keyed(table(spark, sf_dir, "supplier"), ("s_name",), "s_suppkey"))
    return scored(fuzzy.fuzzy_join(a, b, 60, 10))


@query
def top_k_fuzzy(spark, sf_dir):
    return scored(fuzzy.fuzzy_self_join(part_keys(spark, sf_dir), 50, 1))


@query
def fuzzy_customers(spark, sf_dir):
    k = keys.distinct_keys(keys.keyed(table(spark, sf_dir, "customer"), ("c_name",), "c_custkey"))
    return scored(fuzzy.fuzzy_self_join(k, 85, 20))


@query
def idf_corpus(spark, sf_dir):
    corpus = tfidf.idf_corpus(part_keys(spark, sf_dir, ("p_name", "p_type")), master_keys(spark, sf_dir))
    return corpus.groupBy("key").agg(F.count("*").alias("n"))


@query
def document_frequency(spark, sf_dir):
    corpus = tfidf.idf_corpus(part_keys(spark, sf_dir, ("p_name", "p_type")), master_keys(spark, sf_dir))
    return tfidf.document_frequency(tfidf.term_counts(corpus))


@query
def tfidf_dedupe(spark, sf_dir):
    return scored(tfidf.tfidf_self_join(part_keys(spark, sf_dir, (*PART_COLS, "p_type")), 85, 5))


@query
def tfidf_dedupe_by_signatures(spark, sf_dir):
    return scored(tfidf.tfidf_self_join(part_keys(spark, sf_dir, (*PART_COLS, "p_type")), 70, 3, "signatures"))


@query
def tfidf_dedupe_by_pivots(spark, sf_dir):
    return scored(tfidf.tfidf_self_join(part_keys(spark, sf_dir, (*PART_COLS, "p_type")), 85, 5, "metric"))


@query
def tfidf_master_by_pivots(spark, sf_dir):
    return scored(tfidf.tfidf_join(part_keys(spark, sf_dir, ("p_name", "p_type")), master_keys(spark, sf_dir), 60, 5, "metric"))


@query
def tfidf_master(spark, sf_dir):
    return scored(tfidf.tfidf_join(part_keys(spark, sf_dir, ("p_name", "p_type")), master_keys(spark, sf_dir), 60, 5))


@query
def top_k_tfidf(spark, sf_dir):
    return scored(tfidf.tfidf_self_join(part_keys(spark, sf_dir), 50, 1))


@query
def near_duplicate_docs(spark, sf_dir):
    docs = keys.distinct_keys(keys.keyed(table(spark, sf_dir, "documents"), ("text",), "doc_id"))
    return scored(tfidf.tfidf_self_join(docs, 85, 5))


@query
def attach_rows(spark, sf_dir):
    stored = materialise(keys.catalogue(part_rows(spark, sf_dir)), "catalogue")
    pairs = fuzzy.fuzzy_self_join(stored.select("key", "pos"), 85, 3)
    rows = matches.attach_rows(pairs, stored, stored)
    return rows.select("pos_a", "pos_b", "rank", *matches.prefix_rows(rows))


@query
def join_back(spark, sf_dir):
    _, done = reviewed(spark, sf_dir)
    got = matches.join_back(parts(spark, sf_dir), done.records, "p_partkey")
    return got.select("p_partkey", "p_name", F.col("Final Selection").alias("selection"), F.col("Action").alias("action"), F.col("Duplicate_ID").alias("duplicate_id"))


@query
def pending_matches(spark, sf_dir):
    found, done = reviewed(spark, sf_dir, 10)
    return review.pending_matches(found, done.decisions).select("match_id", "score", "match_a", "match_b")


@query
def attach_decisions(spark, sf_dir):
    found, done = reviewed(spark, sf_dir)
    return review.attach_decisions(found, done.decisions).select("match_id", "score", "match_a", "match_b", "choice", "note")


# --- aggregates -------------------------------------------------------------------------------------


@query
def distinct_keys(spark, sf_dir):
    return part_keys(spark, sf_dir)


@query
def last_row_lookup(spark, sf_dir):
    return keys.last_row_lookup(part_rows(spark, sf_dir)).select("key", "row.*")


@query
def score_histogram(spark, sf_dir):
    return report.score_histogram(part_matches(spark, sf_dir))


@query
def histogram_scale(spark, sf_dir):
    return report.histogram_scale(report.score_histogram(part_matches(spark, sf_dir)))


@query
def rank_matches(spark, sf_dir):
    return part_matches(spark, sf_dir).select("match_id", "score", "pos_a", "pos_b", "rank")


@query
def scan_metrics(spark, sf_dir):
    a, b = part_keys(spark, sf_dir, ("p_name", "p_type")), master_keys(spark, sf_dir)
    return report.scan_metrics(a, b, fuzzy.fuzzy_join(a, b, 85, 5))


@query
def scan_products(spark, sf_dir):
    """The metrics of a scan beside what its settings, its exported file and its session hold when read back."""
    cfg = ScanConfig(primary_cols=("p_name", "p_type"), master_cols=("m_name", "m_type"), primary_id="p_partkey", master_id="m_id", file="part.parquet")
    folder = scratch_path(spark, "scan")
    made = jobs.run_scan(parts(spark, sf_dir), cfg, folder, master_parts(spark, sf_dir), "p_partkey", "m_id", "parts")
    exported = tables.read_table(spark, made.export)
    seen = exported.agg(F.count("*").alias("n_exported"), F.count_if(F.col("Score (%)") == 100).alias("n_equal")).first()
    setting = spark.read.parquet(made.settings).first()
    back = {**seen.asDict(), "n_in_session": session.load_session(spark, made.session).matches.count()}
    counts = [F.lit(value).cast("long").alias(name) for name, value in back.items()]
    return made.metrics.select("*", *counts, F.lit(setting["mode"]).alias("mode"), F.lit(setting["cutoff"]).alias("cutoff"))


@query
def review_summary(spark, sf_dir):
    return reviewed(spark, sf_dir)[1].summary


@query
def review_eta(spark, sf_dir):
    n = part_matches(spark, sf_dir).count()
    return report.review_eta(review.in_range(review.replay_index(decision_log(spark, sf_dir, True)), n), n)


# --- decisions --------------------------------------------------------------------------------------


@query
def replay_index(spark, sf_dir):
    return review.replay_index(decision_log(spark, sf_dir, True)).select("session", "seq", "choice", "idx")


@query
def in_range(spark, sf_dir):
    replayed = review.replay_index(decision_log(spark, sf_dir, False))
    return review.in_range(replayed, part_keys(spark, sf_dir).count()).select("seq", "choice", "idx")


@query
def effective_decisions(spark, sf_dir):
    replayed = review.replay_index(decision_log(spark, sf_dir, True))
    return review.effective_decisions(replayed)


@query
def decision_records(spark, sf_dir):
    return reviewed(spark, sf_dir)[1].records


@query
def all_decisions(spark, sf_dir):
    records = reviewed(spark, sf_dir)[1].records
    return records.groupBy("Action").agg(F.count("*").alias("n"), F.round(F.sum("Score"), 1).alias("total"))


@query
def flagged(spark, sf_dir):
    return review.flagged(reviewed(spark, sf_dir)[1].records)


# --- end to end -------------------------------------------------------------------------------------


@query
def dedupe(spark, sf_dir):
    found = part_matches(spark, sf_dir)
    return found.select("match_id", "score", "match_a", "match_b", "row_a.p_partkey", F.col("row_b.p_partkey").alias("other"), "rank")


@query
def dedupe_sampled(spark, sf_dir):
    found = jobs.dedupe(parts(spark, sf_dir), ("p_name",), engine="tfidf", cutoff=50, k=3, sample=True, order_col="p_partkey")
    return found.select("match_id", "score", "match_a", "match_b", "pos_a", "pos_b")


@query
def map_to_master(spark, sf_dir):
    found = jobs.map_to_master(
        parts(spark, sf_dir), master_parts(spark, sf_dir), MAPPINGS, engine="tfidf", cutoff=60, k=3,
        id_col="p_partkey", master_id_col="m_id", order_col="p_partkey", master_order_col="m_id",
    )
    return found.select("match_id", "score", "match_a", "match_b", *matches.project_ids(found, True, "p_partkey", "m_id"))


@query
def review_job(spark, sf_dir):
    """A master scan reviewed to the end."""
    found = jobs.map_to_master(
        parts(spark, sf_dir), master_parts(spark, sf_dir), MAPPINGS, order_col="p_partkey", master_order_col="m_id", k=10,
    )
    found = materialise(found, "matches")
    return jobs.review(found, decision_log(spark, sf_dir, False), True, "p_partkey", "m_id").records


@query
def resume(spark, sf_dir):
    path = scratch_path(spark, "session")
    session.save_session(path, part_matches(spark, sf_dir, 10), False, (), "p_partkey")
    session.append_events(path, decision_log(spark, sf_dir, False))
    return jobs.resume(spark, path).pending.select("match_id", "match_a", "match_b")
