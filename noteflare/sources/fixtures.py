"""Projection of the driver's parquet tables onto the clinical source schema.

The clinical source tables (progress notes, note bodies, assessments,
diagnoses, codes, providers, places of service) are private, so tests and
benchmarks use deterministic projections of the driver's TPC-H-like tables.
The projection is written once, in SQL, and rendered for two engines:

* Spark: ``spark.sql(text, orders=df, ...)`` with parquet-backed frames, so
  no global temp views are needed and Catalyst prunes/pushes into the scans;
* DuckDB (the oracle): a ``WITH`` clause over the pre-registered views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Spark dialect; ``{name}`` marks a base table or an earlier projection.
PROJECTIONS: dict[str, str] = {
    "progressNotes": """
select o_orderkey noteId, o_custkey patientId, o_orderdate noteDate,
  o_orderkey%100 provider, (o_orderkey*7)%100 physician,
  case when o_orderkey%5=0 then null else (o_orderkey*3)%100 end referringPhysician,
  (o_orderkey*11)%120 billingProvider,
  case when o_orderstatus='P' then null else o_orderdate end physicianSignDate,
  cast(o_custkey%30 as int) placeOfService from {orders}""",
    "providers": """
select s_suppkey providerId, substr(s_name,1,8) firstName, substr(s_name,10) lastName from {supplier}""",
    "placeOfService": """
select n_nationkey posCodes, n_name posName from {nation}""",
    "pnAssessment": """
select l_orderkey noteId, 1110+l_partkey%200 dxId, l_linenumber%3 dxCodeId from {lineitem}""",
    "diagnosis": """
select distinct 1110+p_partkey%200 dxId,
  case p_partkey%200%5 when 0 then 'Plaque psoriasis' when 1 then 'Guttate psoriasis'
    when 2 then 'Arthropathic psoriasis' when 3 then 'Pustular psoriasis' else 'Dermatitis' end dxDescription
from {part}""",
    "diagnosisCodes": """
select d.dxId, c.dxCodeId,
  case when d.dxId between 1120 and 1124 or d.dxId=1216 then concat('L40.',cast(c.dxCodeId as string),'0')
       when d.dxId%7=0 then null else concat('L2',cast(d.dxId%10 as string),'.9') end icd10Code
from {diagnosis} d cross join (select 0 dxCodeId union all select 1) c""",
    "newProgressNotes": """
select o_orderkey noteId,
  case (o_orderkey*7+o_custkey)%5 when 0 then 'Increased <b>itching</b> and redness' when 1 then 'No new complaints'
    when 2 then '<p>Psoriasis flare</p><p>without relief</p>' when 3 then null else 'Bothered by dryness' end complaints,
  case (o_orderkey*11+o_custkey*3)%6 when 0 then 'Start triamcinolone ointment' when 1 then 'Stable psoriasis'
    when 2 then 'Flare-up, stress related' when 3 then 'Use steroid cream &amp; follow up' when 4 then null
    else 'Worsening after infection' end assesment,
  case (o_orderkey*13+o_custkey)%5 when 0 then 'no active medications' when 1 then 'clobetasol 0.05%'
    when 2 then 'Adalimumab' when 3 then '' else 'moisturizer' end currentmedication,
  case (o_orderkey*5+o_custkey)%4 when 0 then 'persistent Itch' when 1 then 'dry skin, no fever'
    when 2 then 'denies all' else null end reviewofsystem,
  case (o_orderkey*17+o_custkey)%4 when 0 then 'Plaques with silvery scale on elbows'
    when 1 then 'BSA < 5%, hyperpigmentation' when 2 then 'clear' else null end examination,
  case (o_orderkey*19+o_custkey)%4 when 0 then 'Non-smoker. Alcohol use: yes' when 1 then 'Family melanoma: yes'
    when 2 then '' else null end pastHistory,
  case o_custkey%4 when 0 then concat(cast(20+o_custkey%70 as string),' year old Male patient')
    when 1 then concat(cast(20+o_custkey%70 as string),' year old Female, follow up')
    when 2 then '105 year old Female' else null end patientSummary,
  case o_orderkey%3 when 0 then 'No known drug allergies' when 1 then 'penicillin' else null end allergy,
  case o_orderkey%2 when 0 then 'biopsy' else null end `procedure`,
  cast(null as string) biopsyNotes, cast(null as string) mohsNotes
from {orders}""",
}

# Which projections depend on which (earlier projections must come first).
ORDER = ("progressNotes", "providers", "placeOfService", "pnAssessment", "diagnosis",
         "diagnosisCodes", "newProgressNotes")


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The seven clinical source tables as lazy DataFrames over ``sf_dir``."""
    out: dict[str, DataFrame] = {}
    base = {n: base_table(spark, sf_dir, n) for n in ("orders", "supplier", "nation", "lineitem", "part")}
    for name in ORDER:
        text = PROJECTIONS[name]
        refs = {k: v for k, v in {**base, **out}.items() if "{" + k + "}" in text}
        out[name] = spark.sql(text, **refs)
    return out


def to_duckdb(text: str) -> str:
    """Render a Spark-dialect projection for DuckDB."""
    return text.replace("`", '"').replace(" as string)", " as varchar)")


def duckdb_with_clause(names: tuple[str, ...] = ORDER) -> str:
    """``WITH`` clause defining the projections over the oracle's views."""
    needed: list[str] = []

    def add(n: str) -> None:
        for dep in ORDER:
            if "{" + dep + "}" in PROJECTIONS[n] and dep not in needed:
                add(dep)
        if n not in needed:
            needed.append(n)

    for n in names:
        add(n)
    parts = []
    for n in needed:
        body = to_duckdb(PROJECTIONS[n])
        for t in BASE_TABLES + ORDER:
            body = body.replace("{" + t + "}", t)
        parts.append(f"{n} AS ({body.strip()})")
    return "WITH " + ",\n".join(parts) + "\n"
