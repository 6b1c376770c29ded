"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Outputs are canonical for the oracle compare: flags as int, timestamps as
``yyyy-MM-dd HH:mm:ss`` strings, arrays joined to strings, doubles rounded
to 6 places.  Every query reads the whole driver tables (through the
fixture projection where clinical tables are needed).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteflare.constants import (
    EXTRACT_DROP_COLS,
    FIXTURE_SINCE,
    FLARE_CORR_FEATURES,
    LEXICON_EXTENDED,
    MASK_COLS,
    PSORIASIS_DX_IDS,
    SAFE_NUMERIC_COLS,
    TEXT_COLS,
    TFIDF_INPUT_COLS,
)
from noteflare.functions import features as FE
from noteflare.functions import text as X
from noteflare.operators import eda, extract, label
from noteflare.operators import evaluate as E
from noteflare.operators import model as M
from noteflare.operators import scoring as S
from noteflare.operators import vectors as V
from noteflare.operators.joins import bounded, few_or_note_sized
from noteflare.session import materialize, spread
from noteflare.sources import io as IO
from noteflare.sources.fixtures import base_table, fixture_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# A patient present in the fixture cohort at every scale factor.
LOOKUP_PATIENT = 605  # outside the cohort on the sf0.01 fixture

# Numeric/boolean feature columns correlated with the flare label.
CORR_COLS = (
    "has_psoriasis", "complaint_flare_kw", "complaint_no_relief", "flare_in_assessment",
    "trigger_mentioned", "steroid_started", "has_medications", "on_steroid_med", "on_biologic",
    "plaques_present", "silvery_scale", "elbows_involved", "hyperpigmentation", "itch_present",
    "dry_skin", "fever_absent", "smoker", "alcohol_use", "family_melanoma", "patient_age",
    "follow_up_visit", "has_allergy", "flare_signal", "any_steroid_use", "flare_risk_score",
    "flare_label",
)


def register(name: str) -> Callable[[Query], Query]:
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def canonical(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output types (see module docstring)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, T.BooleanType):
            c = c.cast("int")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ", ")
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        cols.append(c.alias(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------------------
# shared stages
# ---------------------------------------------------------------------------

_TABLES: dict = {}


def tables(spark: SparkSession, sf_dir: str):
    """The fixture tables, built once per session (DataFrames are immutable)."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _TABLES:
        _TABLES[key] = fixture_tables(spark, sf_dir)
    return _TABLES[key]


def notes(spark: SparkSession, sf_dir: str, with_names: bool = True, only: DataFrame | None = None) -> DataFrame:
    return extract.note_base(tables(spark, sf_dir), PSORIASIS_DX_IDS, FIXTURE_SINCE, with_names=with_names, only=only)


_MATERIALIZED: dict = {}


def materialized(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write ``build()`` once per session as Parquet in the shared folder and reuse it.

    The feature table is read by many stages (fits, scoring, reports); each
    later job scans only the columns it needs instead of re-running the
    joins and regexes, and a lost executor costs a re-read, not a
    recomputation.
    """
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, name)
    if key not in _MATERIALIZED:
        _MATERIALIZED[key] = materialize(build(), name)
    return _MATERIALIZED[key]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every extracted note with F1-F29: the wide feature table, written once
    per session and read by the scoring, reporting and training stages."""
    return materialized(spark, sf_dir, "features",
                        lambda: FE.note_features(notes(spark, sf_dir, with_names=False)))


def next_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow (noteId, next-visit label) table computed from the feature
    table, written once; the windows move only these narrow rows."""
    return materialized(spark, sf_dir, "next_labels", lambda: label.next_visit_labels(features(spark, sf_dir)))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that have a next visit, with its label (W1, P11): the feature
    table joined to the narrow label table on the note key."""
    return features(spark, sf_dir).join(few_or_note_sized(next_labels(spark, sf_dir)), "noteId", "inner")


def clear_session_tables() -> None:
    """Forget every table and fit kept for this session.

    They are kept by folder name: call this after data under the same name has been rewritten.
    """
    for kept in (_TABLES, _MATERIALIZED, _SCORERS, _FITS):
        kept.clear()


# ---------------------------------------------------------------------------
# extract (P1-P8, P19, J1-J7, A1, A2)
# ---------------------------------------------------------------------------

@register("cohort_patients")
def q_cohort(spark, sf_dir):
    return extract.cohort_patients(tables(spark, sf_dir), PSORIASIS_DX_IDS, FIXTURE_SINCE)


@register("note_base")
def q_note_base(spark, sf_dir):
    return canonical(notes(spark, sf_dir))


@register("patient_lookup")
def q_patient_lookup(spark, sf_dir):
    return canonical(extract.note_base(tables(spark, sf_dir), PSORIASIS_DX_IDS, FIXTURE_SINCE,
                                       patient_id=LOOKUP_PATIENT))


@register("note_dedup")
def q_note_dedup(spark, sf_dir):
    """One note per patient-day, the lowest note id kept."""
    n = notes(spark, sf_dir, with_names=False).select("noteId", "patientId", "noteDate")
    n = n.withColumn("visit_day", F.to_date("noteDate"))
    out = extract.dedup_notes(n, key=["patientId", "visit_day"], order="noteId")
    return canonical(out.select("patientId", "visit_day", "noteId"))


@register("note_id_dedup")
def q_note_id_dedup(spark, sf_dir):
    """The earliest row per note id, over notes of which many come twice (with another date or none)."""
    n = notes(spark, sf_dir, with_names=False).select("noteId", "patientId", "noteDate")
    k = F.col("noteId") % 4
    day = F.expr("interval 1 day")
    again = n.where(k > 0).withColumn("noteDate", F.when(k == 1, F.col("noteDate") - day)
                                      .when(k == 2, F.col("noteDate") + day))
    return canonical(extract.dedup_notes(n.unionByName(again)))


@register("column_summary")
def q_column_summary(spark, sf_dir):
    return eda.column_summary(notes(spark, sf_dir))


# ---------------------------------------------------------------------------
# text (X1, X2, X6) and features
# ---------------------------------------------------------------------------

@register("clean_html_pages")
def q_clean_pages(spark, sf_dir):
    pages = base_table(spark, sf_dir, "pages")
    return pages.select("page_id", X.clean_html("html").alias("text"))


@register("mask_terms")
def q_mask_terms(spark, sf_dir):
    f = FE.clean_notes(notes(spark, sf_dir, with_names=False))
    return FE.add_masked_text(f).select("noteId", *[c + "_clean" for c in ("assesment", "complaints", "examination",
                                                                           "patientSummary", "currentmedication")])


@register("note_features")
def q_note_features(spark, sf_dir):
    f = features(spark, sf_dir)
    keep = ["noteId", "patientId", "noteDate", *FE.base_feature_columns().keys(),
            "flare_signal", "any_steroid_use", "flare_risk_score", "flare_label"]
    return canonical(f.select(*keep))


@register("note_features_extended")
def q_note_features_extended(spark, sf_dir):
    """F1-F29 with the exploratory (extended) lexicon: the lexicon is a parameter."""
    f = FE.note_features(notes(spark, sf_dir, with_names=False), LEXICON_EXTENDED)
    keep = ["noteId", "patientId", "noteDate", *FE.base_feature_columns().keys(),
            "flare_signal", "any_steroid_use", "flare_risk_score", "flare_label"]
    return canonical(f.select(*keep))


@register("diagnosis_codes")
def q_top_diagnoses(spark, sf_dir):
    return eda.top_diagnoses(features(spark, sf_dir))


@register("top_codes")
def q_top_codes(spark, sf_dir):
    return eda.top_codes(features(spark, sf_dir))


# ---------------------------------------------------------------------------
# labels and split
# ---------------------------------------------------------------------------

@register("next_flare_label")
def q_next_label(spark, sf_dir):
    return labelled(spark, sf_dir).select("noteId", "patientId", "flare_label", label.TARGET)


@register("group_split")
def q_group_split(spark, sf_dir):
    pats = labelled(spark, sf_dir).select("patientId").distinct()
    return label.group_split(pats)


@register("split_summary")
def q_split_summary(spark, sf_dir):
    return canonical(label.split_summary(label.group_split(labelled(spark, sf_dir))))


@register("class_weights")
def q_class_weights(spark, sf_dir):
    train = label.group_split(labelled(spark, sf_dir)).where(F.col("split") == "train")
    return canonical(label.class_weights(train))


# ---------------------------------------------------------------------------
# exploratory
# ---------------------------------------------------------------------------

@register("notes_per_month")
def q_notes_per_month(spark, sf_dir):
    return canonical(eda.notes_per_month(notes(spark, sf_dir, with_names=False)))


@register("notes_per_patient_hist")
def q_hist(spark, sf_dir):
    return canonical(eda.notes_per_patient_hist(notes(spark, sf_dir, with_names=False)))


@register("nonempty_rates")
def q_nonempty(spark, sf_dir):
    cleaned = FE.clean_notes(notes(spark, sf_dir, with_names=False))
    return canonical(eda.nonempty_rates(cleaned, TEXT_COLS))


@register("term_rates")
def q_term_rates(spark, sf_dir):
    return canonical(eda.term_rates(features(spark, sf_dir)))


@register("word_freq")
def q_word_freq(spark, sf_dir):
    return eda.word_freq(base_table(spark, sf_dir, "documents"), "text")


@register("note_word_freq")
def q_note_word_freq(spark, sf_dir):
    """A8 on the three note columns of the report, each with its own most frequent words."""
    f = features(spark, sf_dir)
    per_col = [eda.word_freq(f, c).select(F.lit(c).alias("column_name"), "word", "n")
               for c in ("assesment", "complaints", "examination")]
    return per_col[0].unionByName(per_col[1]).unionByName(per_col[2])


@register("feature_corr")
def q_feature_corr(spark, sf_dir):
    return canonical(eda.corr_matrix(features(spark, sf_dir), FLARE_CORR_FEATURES))


@register("target_corr")
def q_target_corr(spark, sf_dir):
    return canonical(eda.target_corr(features(spark, sf_dir), CORR_COLS, "flare_label"))


@register("cohort_metrics")
def q_cohort_metrics(spark, sf_dir):
    return canonical(eda.cohort_metrics(features(spark, sf_dir)))


@register("monthly_flare_rate")
def q_monthly_flare_rate(spark, sf_dir):
    """Flagship: per month, labelled notes and the share whose next visit is a flare."""
    lab = labelled(spark, sf_dir)
    return canonical(lab.groupBy(X.month_start("noteDate").alias("note_month")).agg(
        F.count(F.lit(1)).alias("n_notes"),
        F.avg(F.col(label.TARGET).cast("double")).alias("next_flare_rate"),
    ))


# ---------------------------------------------------------------------------
# vectors (V2-V4, V6)
# ---------------------------------------------------------------------------

def doc_split(doc_col: str = "doc_id") -> F.Column:
    """V1 applied to documents: the same seeded hash split, keyed by document."""
    return label.split_column(key=doc_col)


def doc_vocabulary(spark, sf_dir, **kw):
    docs = spread(base_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs, V.fit_vocabulary(docs.where(doc_split() == "train"), "text", **kw)


@register("doc_vocab")
def q_doc_vocab(spark, sf_dir):
    _, voc = doc_vocabulary(spark, sf_dir)
    return canonical(voc.terms)


@register("doc_vocab_wide")
def q_doc_vocab_wide(spark, sf_dir):
    """V3 with the exploratory setting (10,000 terms): the vocabulary size is a parameter."""
    _, voc = doc_vocabulary(spark, sf_dir, max_features=10000)
    return canonical(voc.terms)


@register("doc_tfidf")
def q_doc_tfidf(spark, sf_dir):
    docs, voc = doc_vocabulary(spark, sf_dir)
    voc = V.Vocabulary(materialize(voc.terms, "doc-vocabulary"), voc.n_docs)
    return canonical(V.tfidf(docs, voc, "doc_id", "text").select("doc_id", "term", "term_index", "tfidf"))


def note_text(spark, sf_dir) -> DataFrame:
    """X8 over the masked text of labelled notes, with the patient split."""
    lab = label.group_split(FE.add_masked_text(labelled(spark, sf_dir)))
    return lab.withColumn("tfidf_text", X.join_fields(*TFIDF_INPUT_COLS))


@register("note_tfidf")
def q_note_tfidf(spark, sf_dir):
    nt = note_text(spark, sf_dir).select("noteId", "split", "tfidf_text")
    voc = V.fit_vocabulary(nt.where(F.col("split") == "train"), "tfidf_text")
    voc = V.Vocabulary(materialize(voc.terms, "note-vocabulary"), voc.n_docs)
    return canonical(V.tfidf(nt, voc, "noteId", "tfidf_text").select("noteId", "term", "term_index", "tfidf"))


@register("scale_numeric")
def q_scale_numeric(spark, sf_dir):
    lab = label.group_split(labelled(spark, sf_dir))
    scaler = V.fit_scaler(lab.where(F.col("split") == "train"), SAFE_NUMERIC_COLS)
    return canonical(scaler.transform(lab, SAFE_NUMERIC_COLS).select("noteId", "split", *SAFE_NUMERIC_COLS))


# ---------------------------------------------------------------------------
# linear scorer (M3), evaluation (E1-E5), scoring
# ---------------------------------------------------------------------------

_SCORERS: dict = {}


def fitted_scorer(spark, sf_dir):
    """Labelled notes with split and the scorer fitted on the train side
    (fitted once per session: the model is a handful of parameters)."""
    lab = label.group_split(labelled(spark, sf_dir))
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _SCORERS:
        _SCORERS[key] = M.fit_linear_scorer(lab.where(F.col("split") == "train"), label.TARGET,
                                            SAFE_NUMERIC_COLS)
    return lab, _SCORERS[key]


def test_predictions(spark, sf_dir) -> DataFrame:
    lab, scorer = fitted_scorer(spark, sf_dir)
    test = scorer.transform(lab.where(F.col("split") == "test"))
    return test.withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))


def explained_notes(spark, sf_dir) -> DataFrame:
    """Every extracted note scored and explained (K1-K4)."""
    _, scorer = fitted_scorer(spark, sf_dir)
    scored = scorer.transform(features(spark, sf_dir))
    return S.explain_notes(scored, scorer.contributions())


@register("linear_score")
def q_linear_score(spark, sf_dir):
    lab, scorer = fitted_scorer(spark, sf_dir)
    return canonical(scorer.transform(lab).select("noteId", "split", label.TARGET, "probability"))


@register("confusion")
def q_confusion(spark, sf_dir):
    return E.confusion(test_predictions(spark, sf_dir), label.TARGET, "prediction")


@register("class_report")
def q_class_report(spark, sf_dir):
    return canonical(E.class_report(test_predictions(spark, sf_dir), label.TARGET, "prediction"))


@register("roc_auc")
def q_roc_auc(spark, sf_dir):
    return canonical(E.roc_auc(test_predictions(spark, sf_dir), "probability", label.TARGET))


@register("roc_points")
def q_roc_points(spark, sf_dir):
    return canonical(E.roc_points(test_predictions(spark, sf_dir), "probability", label.TARGET))


@register("roc_curve")
def q_roc_curve(spark, sf_dir):
    """The curve without its collinear points."""
    return canonical(E.roc_curve(test_predictions(spark, sf_dir), "probability", label.TARGET))


@register("subgroup_auc")
def q_subgroup_auc(spark, sf_dir):
    return canonical(E.subgroup_auc(test_predictions(spark, sf_dir), "probability", label.TARGET,
                                    "patient_gender", min_rows=30))


@register("note_risk")
def q_note_risk(spark, sf_dir):
    ex = explained_notes(spark, sf_dir)
    return canonical(ex.select("noteId", "patientId", "flare_probability", "flare_label",
                               "flare_risk_level", "explanation_summary"))


@register("top_influences")
def q_top_influences(spark, sf_dir):
    ex = explained_notes(spark, sf_dir)
    return canonical(ex.select("noteId", F.posexplode("key_influences").alias("position", "infl")).select(
        "noteId", "position", "infl.feature", "infl.impact", "infl.direction"))


@register("patient_rollup")
def q_patient_rollup(spark, sf_dir):
    return canonical(S.patient_rollup(explained_notes(spark, sf_dir)))


@register("patients_without_notes")
def q_patients_without_notes(spark, sf_dir):
    patients = base_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("patientId"))
    return canonical(S.patients_without_notes(patients, S.patient_rollup(explained_notes(spark, sf_dir))))


@register("risky_notes")
def q_risky_notes(spark, sf_dir):
    rn = S.risky_notes(explained_notes(spark, sf_dir))
    return canonical(rn.select("patientId", "noteId", "noteDate", "flare_probability", "flare_risk_level",
                               F.transform("patient_influences", lambda s: s["feature"]).alias("influences")))


@register("patient_records")
def q_patient_records(spark, sf_dir):
    """S5 + K6: patients with their ranked notes nested, written as JSON files and read back, one row a note."""
    path = IO.scratch_dir(spark, "patient-records")
    records = S.patient_records(explained_notes(spark, sf_dir))
    IO.write_json(records, path)
    back = spark.read.schema(records.schema).json(path)
    notes_ = back.select("patientId", "total_notes", "final_flare_label", "final_risk_level", "first_rank",
                         F.posexplode("risky_notes").alias("at", "note"))
    return canonical(notes_.select(
        "patientId", "total_notes", "final_flare_label", "final_risk_level", (F.col("first_rank") + F.col("at")).alias("rank"),
        "note.noteId", "note.flare_probability", "note.flare_risk_level",
        F.transform("note.patient_influences", lambda s: s["feature"]).alias("influences")))


@register("influence_map")
def q_influence_map(spark, sf_dir):
    """Feature -> impact maps of each note's interpretable influences by words in their names, as rows."""
    ex = explained_notes(spark, sf_dir)
    found = S.text_signals(F.col("patient_influences"), ("itch", "skin", "psoriasis", "plaques"))
    return canonical(ex.select("noteId", F.explode(found).alias("feature", "impact")))


@register("contract_check")
def q_contract_check(spark, sf_dir):
    ex = explained_notes(spark, sf_dir).select("noteId", "patientId", "flare_probability", "flare_label")
    valid, bad = S.contract_check(ex)
    return canonical(valid.withColumn("violations", F.lit("")).unionByName(
        bad.withColumn("violations", F.array_join("violations", "; "))))


# ---------------------------------------------------------------------------
# Spark ML path (V5, V7, M1, M2, M4, M5, S9) - rows-only checks
# ---------------------------------------------------------------------------

_FITS: dict = {}


def gbt_run(spark, sf_dir):
    """Fit once per (session, data dir): TF-IDF -> SVD -> scale, assemble -> boosted trees -> Platt."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key in _FITS:
        return _FITS[key]
    from pyspark.ml import PipelineModel

    from noteflare.operators import ml
    from noteflare.operators.bundle import Bundle

    p = ml.GbtParams()
    nt = note_text(spark, sf_dir)
    train = F.col("split") == "train"
    # The vocabulary (<= max_features rows) is read back, and its stages run over each note once: the vectors are written.
    words = [(r["term"], r["idf"]) for r in
             V.fit_vocabulary(nt.where(train), "tfidf_text").terms.orderBy("term_index").collect()]
    scaler = V.fit_scaler(labelled(spark, sf_dir).where(label.split_column() == "train"), SAFE_NUMERIC_COLS)
    text = ml.text_stages(words)
    vectors = materialize(PipelineModel(text).transform(nt.select(
        "noteId", "patientId", "noteDate", "split", label.TARGET, "patient_gender", "tfidf_text", *SAFE_NUMERIC_COLS)
        ).drop("tfidf_text"), "note-vectors")
    svd = ml.fit_svd(vectors.where(train), len(words))
    numbers = ml.vector_stages(svd, scaler)
    # Balanced class weights from the narrow training labels (2 rows, bounded).
    cw = label.class_weights(vectors.where(train)).select(label.TARGET, F.col("weight").alias("_cw"))
    data = PipelineModel(numbers).transform(vectors).join(bounded(cw), label.TARGET, "left").withColumns({
        "weight": F.when(train, F.col("_cw")).otherwise(F.lit(1.0)),
        "fold": F.when(train, ml.fold_column(p)).otherwise(F.lit("test"))})
    data = materialize(data.select("noteId", "patientId", "noteDate", "split", "fold", "weight", label.TARGET,
                                   "patient_gender", "features"), "model-input")
    fold = lambda name: data.where(F.col("fold") == name)
    fit = ml.fit_gbt(fold("grow"), fold("stop"), label.TARGET, "weight", p)
    scored = ml.positive_probability(fit.model.transform(data))
    platt = ml.fit_platt(scored.where(F.col("fold") == "calibrate"), label.TARGET)
    facts = {"best_round": fit.best_round, "rounds_fitted": fit.rounds_fitted, "patience": p.patience,
             "validation_auc": fit.validation_auc[fit.best_round - 1], "n_terms": len(words), "n_components": svd.k}
    bundle = Bundle(PipelineModel([*text, *numbers, fit.model, *platt.stages]), facts)
    out = {"data": data, "vectors": vectors, "fit": fit, "model": fit.model, "scored": scored, "platt": platt,
           "names": ml.feature_names(SAFE_NUMERIC_COLS, svd.k), "svd": svd, "scaler": scaler, "bundle": bundle}
    _FITS[key] = out
    return out


@register("note_json")
def q_note_json(spark, sf_dir):
    """Each scored note as a nested JSON document (influences array, signals map)."""
    ex = explained_notes(spark, sf_dir)
    doc = F.to_json(F.struct("noteId", F.date_format("noteDate", "yyyy-MM-dd").alias("noteDate"),
                             "flare_probability", "flare_risk_level",
                             F.col("patient_influences").alias("key_influences"), "text_signals"))
    return ex.select("patientId", "noteId", doc.alias("json"))


@register("patient_json")
def q_patient_json(spark, sf_dir):
    """S5 + K5: one JSON header per patient (roll-up fields); the ranked notes
    are the ``risky_notes`` rows, keyed by patient, so no patient's notes are
    gathered into one record or task."""
    r = S.patient_rollup(explained_notes(spark, sf_dir))
    doc = F.to_json(F.struct("patientId", "total_notes", "final_flare_label", "final_risk_level"))
    return r.select("patientId", doc.alias("json"))


@register("svd_project")
def q_svd_project(spark, sf_dir):
    """V5: each labelled note's SVD components, by the row-wise stage over its TF-IDF vector."""
    from pyspark.ml.functions import vector_to_array

    from noteflare.operators import ml
    r = gbt_run(spark, sf_dir)
    return ml.svd_stage(r["svd"]).transform(r["vectors"]).select("noteId", vector_to_array("svd_vec").alias("svd"))


@register("gbt_train_eval")
def q_gbt_train_eval(spark, sf_dir):
    r = gbt_run(spark, sf_dir)
    test = r["scored"].where(F.col("split") == "test").select(
        "noteId", "patientId", label.TARGET, F.col("p").alias("probability"),
        F.col("prediction").cast("int").alias("prediction"))
    return test


@register("gbt_metrics")
def q_gbt_metrics(spark, sf_dir):
    """Test-fold AUC and weighted report of the boosted model, with its rounds and patience (rows-only)."""
    r = gbt_run(spark, sf_dir)
    test = r["scored"].where(F.col("split") == "test").withColumn("pred", F.col("prediction").cast("int"))
    auc = E.roc_auc(test, "p", label.TARGET).select(F.lit("roc_auc").alias("metric"), F.col("auc").alias("value"))
    rep = E.class_report(test, label.TARGET, "pred").where(F.col("class") == "weighted avg")
    w = rep.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("precision", "recall", "f1")])))
    from noteflare.operators.bundle import metrics_rows
    facts = spark.createDataFrame(metrics_rows(r["bundle"]), "metric string, value double")
    return auc.unionByName(w).unionByName(facts)


@register("gbt_rounds")
def q_gbt_rounds(spark, sf_dir):
    """M1: validation AUC of every prefix of the ensemble, the curve the best round is read from."""
    auc = gbt_run(spark, sf_dir)["fit"].validation_auc  # a number a round
    return spark.createDataFrame([(i + 1, float(a)) for i, a in enumerate(auc)], "round int, validation_auc double")


@register("calibrated")
def q_calibrated(spark, sf_dir):
    from noteflare.operators import ml
    r = gbt_run(spark, sf_dir)
    out = ml.calibrate(r["scored"].where(F.col("split") == "test"), r["platt"])
    return out.select("noteId", F.col("p").alias("probability"), "p_calibrated")


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    """M5 + S8: the twenty most important features, written as CSV and read back."""
    from noteflare.operators import ml
    r = gbt_run(spark, sf_dir)
    path = IO.scratch_dir(spark, "importance")
    IO.write_csv(ml.feature_importance(r["model"], r["names"], top=20), path)
    back = spark.read.option("header", True).schema("feature string, importance double").csv(path)
    return back.orderBy(F.col("importance").desc(), F.col("feature").asc())


@register("split_counts")
def q_split_counts(spark, sf_dir):
    """M5: how often, with what gain and in how many trees each feature splits a node."""
    from noteflare.operators import ml
    r = gbt_run(spark, sf_dir)
    return ml.split_counts(r["model"], r["names"])


@register("model_influences")
def q_model_influences(spark, sf_dir):
    """K2, K3, W3 on the whole model vector: a linear scorer over scaled numerics and SVD components of the labelled notes.

    The five largest contributions of a note, SVD components shown as ``text_signal`` and named once.
    """
    from pyspark.ml.functions import vector_to_array
    r = gbt_run(spark, sf_dir)
    x = vector_to_array("features")
    wide = r["data"].select("noteId", "split", label.TARGET, x.alias("x")).select(
        "noteId", "split", label.TARGET, *[F.col("x")[i].alias(n) for i, n in enumerate(r["names"])])
    scorer = M.fit_linear_scorer(wide.where(F.col("split") == "train"), label.TARGET, r["names"])
    top = scorer.transform(wide).select("noteId", S.top_influences(scorer.contributions()).alias("infl"))
    # Outer: a plain posexplode makes Catalyst rank each note a second time, to ask whether its list is empty (it never is).
    return canonical(top.select("noteId", F.posexplode_outer("infl").alias("position", "i")).select(
        "noteId", "position", "i.feature", "i.impact", "i.direction"))


@register("model_roundtrip")
def q_model_roundtrip(spark, sf_dir):
    """Save the bundle as a new version, load the latest complete one, score the test fold's raw notes with it."""
    from noteflare.operators import bundle as B
    r = gbt_run(spark, sf_dir)
    root = IO.scratch_dir(spark, "models")
    B.save_bundle(spark, r["bundle"], root)
    loaded = B.load_bundle(spark, root)
    ids = r["data"].where(F.col("split") == "test").select("noteId")
    raw = request_rows(spark, sf_dir, only=few_or_note_sized(ids))
    return loaded.score_notes(raw).select(F.col("noteId").cast("long").alias("noteId"), F.col("p").alias("probability"),
                                          "p_calibrated", "flare_risk_level")


# ---------------------------------------------------------------------------
# sources / sinks (S2-S8, P10) and streaming
# ---------------------------------------------------------------------------

def request_rows(spark, sf_dir, only: DataFrame | None = None) -> DataFrame:
    """Extracted notes, or ``only`` those of some ids, in the scoring-request layout (ids and dates as text)."""
    from noteflare.operators.bundle import as_request
    return as_request(notes(spark, sf_dir, with_names=False, only=only), IO.REQUEST_TEXT_FIELDS)


def _shape_col() -> F.Column:
    """Spread notes over the three JSON line shapes by note id."""
    k = F.col("noteId").cast("long") % 3
    return F.when(k == 0, "object").when(k == 1, "wrapped").otherwise("list")


def _risk_cols(df: DataFrame) -> DataFrame:
    return canonical(df.select("noteId", "patientId", "flare_probability", "flare_label", "flare_risk_level",
                               "explanation_summary"))


@register("json_batch_score")
def q_json_batch_score(spark, sf_dir):
    """S4 + K8: notes written as JSON lines in mixed shapes, read back, scored."""
    from noteflare.streaming.score_stream import scored_notes
    path = IO.scratch_dir(spark, "json-batch")
    IO.write_note_batches(request_rows(spark, sf_dir).withColumn("_shape", _shape_col()), path)
    _, scorer = fitted_scorer(spark, sf_dir)
    valid, _bad = S.contract_check(scored_notes(IO.read_note_batch_json(spark, path), scorer))
    return _risk_cols(valid)


def spoilt_requests(spark, sf_dir) -> DataFrame:
    """Request rows, every tenth also with an id that is no number and again without a patient."""
    rows = request_rows(spark, sf_dir)
    odd = rows.where(F.col("noteId").cast("long") % 10 == 0)
    return rows.unionByName(odd.withColumn("noteId", F.concat(F.lit("P-"), "noteId"))).unionByName(
        odd.withColumn("patientId", F.lit("")))


@register("json_batch_rejects")
def q_json_batch_rejects(spark, sf_dir):
    """K8 + P18: request rows with unusable ids come back with their reasons, beside good ones."""
    from noteflare.streaming.score_stream import rejected_notes
    path = IO.scratch_dir(spark, "json-rejects")
    IO.write_note_batches(spoilt_requests(spark, sf_dir).withColumn("_shape", F.lit("object")), path)
    return canonical(rejected_notes(IO.read_note_batch_json(spark, path)))


@register("stream_score_and_reject")
def q_stream_both(spark, sf_dir):
    """T1 + K8: scores and rejects from one stream over one read; the outcome is the risk level or the reasons."""
    from noteflare.streaming.score_stream import read_batches, start_scoring_and_reject_stream
    src = IO.scratch_dir(spark, "both-in")
    IO.write_note_batches(spoilt_requests(spark, sf_dir).withColumn("_shape", F.lit("object")), src)
    _, scorer = fitted_scorer(spark, sf_dir)
    good, bad = IO.scratch_dir(spark, "both-scores"), IO.scratch_dir(spark, "both-rejects")
    start_scoring_and_reject_stream(spark, src, good, bad, IO.scratch_dir(spark, "both-ckpt"), scorer,
                                    max_files_per_trigger=4).awaitTermination()
    text = lambda c: F.col(c).cast("string").alias(c)
    scored = read_batches(spark, good).select(text("noteId"), text("patientId"), F.col("flare_risk_level").alias("outcome"))
    return scored.unionByName(read_batches(spark, bad).select("noteId", "patientId", F.col("reasons").alias("outcome")))


@register("csv_roundtrip_score")
def q_csv_roundtrip(spark, sf_dir):
    """S2 + S3: note table to CSV (multi-line quoted text) and back, then scored."""
    from noteflare.streaming.score_stream import scored_notes
    path = IO.scratch_dir(spark, "csv-notes")
    IO.write_csv(request_rows(spark, sf_dir), path)
    _, scorer = fitted_scorer(spark, sf_dir)
    return _risk_cols(scored_notes(IO.read_note_csv(spark, path), scorer))


@register("parquet_features_roundtrip")
def q_parquet_roundtrip(spark, sf_dir):
    """Feature table written to Parquet (partitioned by split) and read back."""
    path = IO.scratch_dir(spark, "features")
    lab = label.group_split(labelled(spark, sf_dir))
    IO.write_parquet(lab.select("noteId", "patientId", "split", label.TARGET, *SAFE_NUMERIC_COLS), path,
                     partition_by=("split",))
    back = spark.read.parquet(path)
    return canonical(back.select("noteId", "patientId", "split", label.TARGET, *SAFE_NUMERIC_COLS))


@register("metrics_log")
def q_metrics_log(spark, sf_dir):
    """Evaluation metrics of the linear scorer in a metrics table; the run is logged twice, as a retried job would."""
    path = IO.scratch_dir(spark, "metrics")
    test = test_predictions(spark, sf_dir)
    auc = E.roc_auc(test, "probability", label.TARGET).select(F.lit("roc_auc").alias("name"),
                                                               F.col("auc").alias("value"))
    rep = E.class_report(test, label.TARGET, "prediction").where(F.col("class") == "weighted avg")
    rest = rep.select(F.inline(F.array(*[F.struct(F.lit(m).alias("name"), F.col(m).alias("value"))
                                         for m in ("precision", "recall", "f1")])))
    rates = test.agg(F.avg(F.col(label.TARGET).cast("double")).alias("value")).select(
        F.lit("test_positive_rate").alias("name"), "value")
    found = auc.unionByName(rest).unionByName(rates)
    IO.log_metrics(spark, path, "run-1", found)
    logged = IO.log_metrics(spark, path, "run-1", found)
    return canonical(logged.select("run_id", "name", "value"))


@register("stream_score")
def q_stream_score(spark, sf_dir):
    """The same notes scored by a Structured Streaming job (equals the batch result)."""
    from noteflare.streaming.score_stream import start_scoring_stream
    src = IO.scratch_dir(spark, "stream-in")
    IO.write_note_batches(request_rows(spark, sf_dir).withColumn("_shape", _shape_col()), src)
    _, scorer = fitted_scorer(spark, sf_dir)
    sink, ckpt = IO.scratch_dir(spark, "stream-out"), IO.scratch_dir(spark, "stream-ckpt")
    q = start_scoring_stream(spark, src, sink, ckpt, scorer, available_now=True, max_files_per_trigger=2)
    q.awaitTermination()
    return _risk_cols(spark.read.parquet(sink))


# ---------------------------------------------------------------------------
# small table operators
# ---------------------------------------------------------------------------

@register("feature_table")
def q_feature_table(spark, sf_dir):
    """The training feature table: tidy labels, drop extract-only
    and label-defining columns, keep rows with a next-visit label."""
    n = extract.tidy_columns(notes(spark, sf_dir), EXTRACT_DROP_COLS)
    feats = FE.add_masked_text(FE.note_features(n))
    out = label.drop_leaks(feats.join(few_or_note_sized(next_labels(spark, sf_dir)), "noteId", "inner"))
    keep = ["noteId", "patientId", "noteDate", *SAFE_NUMERIC_COLS, "patient_gender", label.TARGET,
            *[c + "_clean" for c in MASK_COLS]]
    return canonical(out.select(*keep))


@register("flag_rates")
def q_flag_rates(spark, sf_dir):
    """A10: flare-signal, steroid-use and label rates overall and per split."""
    lab = label.group_split(labelled(spark, sf_dir))
    rates = {"flare_signal_rate": "flare_signal", "steroid_use_rate": "any_steroid_use",
             "target_rate": label.TARGET}
    aggs = [F.avg(F.col(c).cast("double")).alias(n) for n, c in rates.items()]
    overall = lab.agg(*aggs).select(F.lit("all").alias("split"), *rates)
    return canonical(overall.unionByName(lab.groupBy("split").agg(*aggs)))


@register("notes_per_patient")
def q_notes_per_patient(spark, sf_dir):
    return eda.notes_per_patient(notes(spark, sf_dir, with_names=False))


@register("row_counts")
def q_row_counts(spark, sf_dir):
    n = notes(spark, sf_dir, with_names=False)
    return n.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("noteId").alias("n_notes"),
                 F.countDistinct("patientId").alias("n_patients"))


@register("head_notes")
def q_head_notes(spark, sf_dir):
    """P13 + P14: the first notes in (patient, date, id) order (a head report)."""
    n = notes(spark, sf_dir, with_names=False).select("noteId", "patientId", "noteDate")
    return canonical(n.orderBy(F.col("patientId"), F.col("noteDate").asc_nulls_last(), F.col("noteId")).limit(6))


@register("sample_notes")
def q_sample_notes(spark, sf_dir):
    """Ten notes drawn by a hash of their id, the same for any partitioning (a sampling report)."""
    drawn = F.md5(F.col("noteId").cast("string").cast("binary"))
    return notes(spark, sf_dir, with_names=False).select("noteId", "patientId").orderBy(drawn, "noteId").limit(10)


@register("boolean_columns")
def q_boolean_columns(spark, sf_dir):
    """Keep the columns of one type (here the boolean flags)."""
    f = features(spark, sf_dir)
    kept = [fl.name for fl in f.schema.fields if isinstance(fl.dataType, T.BooleanType)]
    return canonical(f.select("noteId", *kept))
