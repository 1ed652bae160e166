"""The census warehouse: staging, validation, star schema, mart and features.

``Census`` holds a warehouse folder; ``ingest`` loads one file or all of a folder.
Loads are repeatable: a row's key is its content and occurrence in its file, so a
file that was read before adds nothing. A run is reported ok only after the mart
and the features are rebuilt.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.functions import content_hash, freshness_state, hours_between, lenient_int, record_key, round_to_int
from sparkwright.operators import dims, facts, features, keys, quality, rules, serve
from sparkwright.operators.relational import counted
from sparkwright.sources import Warehouse, csv_text, dashboard, fingerprint, name_sorted, numbered_lines

# Source columns in file order and their staged names.
COLUMNS = {
    "age": "age",
    "workclass": "workclass",
    "fnlwgt": "fnlwgt",
    "education": "education",
    "education.num": "education_num",
    "marital.status": "marital_status",
    "occupation": "occupation",
    "relationship": "relationship",
    "race": "race",
    "sex": "sex",
    "capital.gain": "capital_gain",
    "capital.loss": "capital_loss",
    "hours.per.week": "hours_per_week",
    "native.country": "native_country",
    "income": "income",
}
# The education ladder (level, label, group).
EDUCATION = [
    (1, "Preschool", "No high school diploma"),
    (2, "1st-4th", "No high school diploma"),
    (3, "5th-6th", "No high school diploma"),
    (4, "7th-8th", "No high school diploma"),
    (5, "9th", "No high school diploma"),
    (6, "10th", "No high school diploma"),
    (7, "11th", "No high school diploma"),
    (8, "12th", "No high school diploma"),
    (9, "HS-grad", "High school graduate"),
    (10, "Some-college", "Some college"),
    (11, "Assoc-voc", "Associate degree"),
    (12, "Assoc-acdm", "Associate degree"),
    (13, "Bachelors", "Bachelors degree"),
    (14, "Masters", "Postgraduate"),
    (15, "Prof-school", "Postgraduate"),
    (16, "Doctorate", "Postgraduate"),
]
# Sentinels of censored measures, the pool, and the sparse limit.
SENTINELS = {"age": 90, "hours_per_week": 99, "capital_gain": 99999}
POOL = "income_gt_50k = false and age between 25 and 54"
SPARSE_BELOW = 30

DIMENSIONS = [
    dims.Dimension("workclass", marker="?", optional=True, flags=("is_unknown",)),
    dims.Dimension("marital_status"),
    dims.Dimension("occupation", marker="?", optional=True, flags=("is_unknown", "is_not_applicable")),
    dims.Dimension("relationship"),
    dims.Dimension("race"),
    dims.Dimension("sex", only=("Male", "Female")),
    dims.Dimension("native_country", marker="?", optional=True, flags=("is_unknown",)),
]

_TEXTS = ", ".join(f"{c} string" for c in COLUMNS.values())
_LINEAGE = "record_key string, load_run_id long, source_file string, source_row long"
SCHEMAS = {
    "load_event": "load_run_id long, source_file string, file_sha256 string, file_bytes long, status string, event_at timestamp, event_no int, rows_read long, rows_staged long, rows_rejected long, rows_loaded long, rows_already_present long, message string",
    "stg_adult": f"{_LINEAGE}, {_TEXTS}",
    "load_reject": f"{_LINEAGE}, reason string, detail string",
    "quarantine": f"{_LINEAGE}, reason string, detail string, quarantined_at timestamp, {_TEXTS}",
    "dim_education": "education_sk int, education string, education_num int, education_group string",
    **{f"dim_{d.name}": f"{d.key} int, {d.name} string" + "".join(f", {f} boolean" for f in d.flags) for d in DIMENSIONS},
    "fact_person": f"person_sk long, {_LINEAGE}, workclass_sk int, education_sk int, marital_status_sk int, occupation_sk int, relationship_sk int, race_sk int, sex_sk int, native_country_sk int, "
    "age short, age_is_topcoded boolean, hours_per_week short, hours_per_week_is_topcoded boolean, capital_gain int, capital_gain_is_topcoded boolean, capital_loss int, fnlwgt int, income_gt_50k boolean, "
    "duplicate_group_id int, duplicate_seq int",
    "mart_segment_allocation": "occupation string, education_group string, candidates int, pct_of_eligible_pool double, mean_hours double, mean_capital_gain double, hours_measured_on int, capital_gain_measured_on int, "
    "segment_is_sparse boolean, occupation_is_assignable boolean, refreshed_at timestamp, source_load_run_id long",
    "feature_person": "person_sk long, split string, duplicate_group_id int, income_gt_50k boolean, age short, age_band string, education_num int, education_vs_occupation_median short, hours_per_week short, "
    "hours_vs_occupation_median double, is_full_time boolean, workclass_group string, occupation string, occupation_is_assignable boolean, is_partnered boolean, relationship string, race string, sex string, "
    "country_is_united_states boolean, age_was_censored boolean, hours_was_censored boolean",
    "quality_check_result": "checked_at timestamp, " + quality.SCHEMA,
}


def row_rules() -> list[rules.Rule]:
    """Reasons to refuse a staged row; an unanswered question (``?``) is none."""
    whole = lambda c, kind="int": lenient_int(c, kind)
    pairs = F.array(*(F.struct(F.lit(label).alias("a"), F.lit(level).alias("b")) for level, label, _ in EDUCATION))
    pair = F.struct(F.col("education").alias("a"), whole("education_num").alias("b"))
    known = F.col("education").isNotNull() & whole("education_num").isNotNull() & F.array_contains(pairs, pair)
    gain, loss = whole("capital_gain"), whole("capital_loss")
    must = ("age", "workclass", "education", "marital_status", "occupation", "relationship", "race", "sex", "native_country", "income")
    return [
        rules.Rule("age_not_an_integer", whole("age").isNull(), rules.labelled(age="age")),
        rules.Rule("age_out_of_range", ~whole("age").between(1, 120), rules.labelled(age="age")),
        rules.Rule("fnlwgt_not_a_positive_integer", whole("fnlwgt", "long").isNull() | (whole("fnlwgt", "long") <= 0), rules.labelled(fnlwgt="fnlwgt")),
        rules.Rule("hours_per_week_out_of_range", whole("hours_per_week").isNull() | ~whole("hours_per_week").between(1, 99), rules.labelled(hours__per__week="hours_per_week")),
        rules.Rule("capital_value_invalid", gain.isNull() | loss.isNull() | (gain < 0) | (loss < 0), rules.labelled(gain="capital_gain", loss="capital_loss")),
        rules.Rule("income_not_recognised", F.col("income").isNull() | ~F.col("income").isin("<=50K", ">50K"), rules.labelled(income="income")),
        rules.Rule("sex_not_recognised", F.col("sex").isNull() | ~F.col("sex").isin("Male", "Female"), rules.labelled(sex="sex")),
        rules.Rule("education_mapping_mismatch", ~known, rules.labelled(education="education", education__num="education_num")),
        rules.required({c: next(k for k, v in COLUMNS.items() if v == c) for c in must}),
    ]


class Census:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.store = Warehouse(spark, root, SCHEMAS)

    def create(self) -> None:
        for name, schema in SCHEMAS.items():
            self.store.create(name, schema)
        seed = self.spark.createDataFrame([(n, label, n, group) for n, label, group in EDUCATION], SCHEMAS["dim_education"])
        self.store.append_absent("dim_education", seed, ["education_sk"])
        for d in DIMENSIONS:
            reserved = []
            if "is_unknown" in d.flags:
                reserved.append((dims.UNKNOWN, "Unknown", *(f == "is_unknown" for f in d.flags)))
            if "is_not_applicable" in d.flags:
                reserved.append((dims.NOT_APPLICABLE, "Not applicable", *(f == "is_not_applicable" for f in d.flags)))
            if reserved:
                self.store.append_absent(f"dim_{d.name}", self.spark.createDataFrame(reserved, SCHEMAS[f"dim_{d.name}"]), [d.key])

    # Steps of a load --------------------------------------------------------------

    def stage(self, path: str, run: int) -> tuple[int, int]:
        """(rows read, rows staged): rows whose key is new."""
        lines = numbered_lines(csv_text(self.spark, path, list(COLUMNS)))
        lines = lines.select("source_row", *(F.col(f"`{k}`").alias(v) for k, v in COLUMNS.items())).withColumn("_hash", content_hash(COLUMNS.values()))
        n = F.row_number().over(Window.partitionBy("_hash").orderBy("source_row"))
        incoming = lines.withColumn("record_key", record_key("_hash", n)).withColumn("load_run_id", F.lit(run)).withColumn("source_file", F.lit(path.rpartition("/")[2])).persist()
        try:
            read, before = incoming.count(), self.store.read("stg_adult").count()
            self.store.append_absent("stg_adult", incoming, ["record_key"])
            return read, self.store.read("stg_adult").count() - before
        finally:
            incoming.unpersist()

    def refuse(self, run: int) -> None:
        """Reject rows of this run and copy the refused rows whole."""
        staged = self.store.read("stg_adult").where(F.col("load_run_id") == run)
        lineage = ["record_key", "load_run_id", "source_file", "source_row"]
        repeated = rules.repeated_keys(staged, "record_key").join(staged.select(*lineage).dropDuplicates(["record_key"]), "record_key")
        found = rules.rejects(staged, row_rules(), lineage).unionByName(repeated)
        self.store.append_absent("load_reject", found, ["record_key", "reason"])
        refused = self.store.read("load_reject").where(F.col("load_run_id") == run)
        whole = refused.join(staged.select("record_key", *COLUMNS.values()), "record_key")
        self.store.append_absent("quarantine", whole.withColumn("quarantined_at", F.current_timestamp()), ["record_key", "reason"])

    def upsert_dimensions(self) -> None:
        staged = self.store.read("stg_adult")
        for d in DIMENSIONS:
            self.store.append(f"dim_{d.name}", dims.new_members(staged, self.store.read(f"dim_{d.name}"), d))

    def load_facts(self) -> int:
        staged, fact = self.store.read("stg_adult"), self.store.read("fact_person")
        fresh = rules.admissible(staged, self.store.read("load_reject"), fact, "record_key").withColumn("content_hash", F.substring("record_key", 1, 32))
        universe = fresh.select("content_hash", "source_row").union(fact.select(F.substring("record_key", 1, 32), "source_row"))
        marked = keys.mark_duplicates(fresh, "content_hash", "source_row", universe)
        top = fact.agg(F.max("person_sk")).first()[0] or 0
        numbered = keys.number_globally(marked, ["source_file", "source_row", "record_key"], "person_sk", top)
        for d in DIMENSIONS:
            table = self.store.read(f"dim_{d.name}").select(F.col(d.name).alias("_label"), d.key)
            numbered = numbered.join(table, F.col(d.name) == F.col("_label"), "left" if d.optional else "inner").drop("_label")
        excused = F.coalesce(F.col("workclass") == "Never-worked", F.lit(False))
        numbered = numbered.withColumns({
            "occupation_sk": dims.unknown_or_not_applicable("occupation", "?", excused, F.col("occupation_sk")),
            "workclass_sk": F.coalesce("workclass_sk", F.lit(dims.UNKNOWN)), "native_country_sk": F.coalesce("native_country_sk", F.lit(dims.UNKNOWN)),
        }).join(self.store.read("dim_education").select("education_sk", "education"), "education")
        typed = numbered.withColumns({
            "age": lenient_int("age", "short"), "hours_per_week": lenient_int("hours_per_week", "short"), "capital_gain": lenient_int("capital_gain"), "capital_loss": lenient_int("capital_loss"),
            "fnlwgt": lenient_int("fnlwgt"), "income_gt_50k": F.col("income") == ">50K",
        })
        before = fact.count()
        self.store.append("fact_person", facts.censor(typed, SENTINELS))
        loaded = self.store.read("fact_person").count() - before
        self.store.require(self.store.read("fact_person"), not_null=["record_key", "person_sk", "source_file", "source_row"], unique=["record_key"])
        return loaded

    # Serving --------------------------------------------------------------------------

    def analytic(self, *only: str) -> DataFrame:
        """The flattened star; with ``only``, just the dimensions that these labels need."""
        table = lambda d: self.store.read(f"dim_{d}")
        fact = self.store.read("fact_person")
        renamed = {"workclass": ["is_unknown"], "occupation": ["is_unknown", "is_not_applicable"], "native_country": ["is_unknown"]}
        named: list[tuple[DataFrame, str]] = []
        for d in [*(x.name for x in DIMENSIONS), "education"]:
            if only and d not in only:
                continue
            t = table(d)
            for flag in renamed.get(d, []):
                t = t.withColumnRenamed(flag, f"{d}_{flag.removeprefix('is_')}")
            named.append((t, f"{d}_sk"))
        return serve.flatten(fact, named, ["*"]).drop(*(f"{d.name}_sk" for d in DIMENSIONS), "education_sk")

    def allocation(self) -> DataFrame:
        pool = self.analytic("occupation", "education").where(POOL).where("not occupation_unknown and not occupation_not_applicable")
        return serve.allocation(pool, ["occupation", "education_group"], {"mean_hours": ("hours_per_week", 1), "mean_capital_gain": ("capital_gain", 2)}, F.col("capital_gain_is_topcoded"), SPARSE_BELOW)

    def pool_breakdown(self) -> DataFrame:
        pool = self.analytic("occupation").where(POOL)
        return counted(pool, {"eligible pool": F.lit(True), "of those, occupation not answered": F.col("occupation_unknown"), "of those, no occupation to record": F.col("occupation_not_applicable")})

    def sentinel_impact(self) -> DataFrame:
        rows = self.analytic("occupation").where("not occupation_unknown and not occupation_not_applicable")
        return rows.groupBy("occupation").agg(
            F.round(F.avg("capital_gain"), 0).alias("mean_excluding_sentinel"), F.round(F.avg(facts.uncensored("capital_gain", 99999)), 0).alias("mean_including_sentinel"), F.count_if("capital_gain_is_topcoded").alias("censored_rows")
        ).orderBy(F.desc("mean_including_sentinel"), "occupation")

    def refresh_mart(self) -> None:
        pool = self.analytic("occupation", "education").where(POOL)
        made = serve.segment_mart(pool, ["occupation", "education_group"], {"hours": "hours_per_week", "capital_gain": "capital_gain"}, F.col("occupation_unknown") | F.col("occupation_not_applicable"), SPARSE_BELOW)
        run = self.store.read("fact_person").agg(F.max("load_run_id").alias("source_load_run_id"))
        made = made.withColumnRenamed("is_assignable", "occupation_is_assignable").withColumn("refreshed_at", F.current_timestamp()).join(F.broadcast(run))
        self.store.overwrite("mart_segment_allocation", made.select(*_names("mart_segment_allocation")))

    def build_features(self) -> None:
        rows = self.analytic()
        norms = features.norms(self.analytic("occupation", "education"), "occupation", {"med_hours": "hours_per_week", "med_education": "education_num"})
        group = lambda *labels: F.col("workclass").isin(*labels)
        cols: dict[str, Column] = {
            "split": features.split(F.col("duplicate_group_id"), F.col("person_sk"), F.col("income_gt_50k")),
            "age_band": features.band("age", [(25, "under 25"), (35, "25 to 34"), (45, "35 to 44"), (55, "45 to 54")], "55 and over", "censored"),
            "education_vs_occupation_median": round_to_int(F.col("education_num") - F.col("med_education")),
            "hours_vs_occupation_median": F.when(F.col("med_hours") > 0, F.col("hours_per_week") / F.col("med_hours")),
            "is_full_time": F.col("hours_per_week") >= 35,
            "workclass_group": F.when(group("Private"), "private").when(group("Federal-gov", "State-gov", "Local-gov"), "government").when(group("Self-emp-inc", "Self-emp-not-inc"), "self-employed").otherwise("other or unknown"),
            "occupation_is_assignable": ~(F.col("occupation_unknown") | F.col("occupation_not_applicable")),
            "is_partnered": F.col("marital_status").isin("Married-civ-spouse", "Married-AF-spouse"),
            "country_is_united_states": F.col("native_country") == "United-States",
            "age_was_censored": F.col("age_is_topcoded"),
            "hours_was_censored": F.col("hours_per_week_is_topcoded"),
        }
        self.store.overwrite("feature_person", rows.join(norms, "occupation").withColumns(cols).select(*_names("feature_person")))

    # Runs ---------------------------------------------------------------------------------

    def _event(self, run: int, path: str, status: str, number: int, **values) -> None:
        row = {"load_run_id": run, "source_file": path.rpartition("/")[2], "status": status, "event_no": number, "event_at": dt.datetime.now(dt.timezone.utc)} | values
        self.store.append("load_event", self.spark.createDataFrame([tuple(row.get(c) for c in _names("load_event"))], SCHEMAS["load_event"]))

    def ingest_file(self, path: str) -> dict:
        self.create()
        run = (self.store.read("load_event").agg(F.max("load_run_id")).first()[0] or 0) + 1
        digest, size = fingerprint(self.spark, path)
        self._event(run, path, "running", 0, file_sha256=digest, file_bytes=size)
        try:
            read, staged = self.stage(path, run)
            self.refuse(run)
            self.upsert_dimensions()
            loaded = self.load_facts()
            self.refresh_mart()
            self.build_features()
            refused = self.store.read("load_reject").where(F.col("load_run_id") == run).select("record_key").distinct().count()
            if staged != refused + loaded:
                raise ValueError(f"{staged} rows were staged, but {refused} refused and {loaded} loaded")
            counts = {"rows_read": read, "rows_staged": staged, "rows_rejected": refused, "rows_loaded": loaded, "rows_already_present": read - staged}
            self._event(run, path, "ok", 1, file_sha256=digest, file_bytes=size, **counts)
            return {"load_run_id": run} | counts
        except Exception as e:
            self._event(run, path, "failed", 1, file_sha256=digest, file_bytes=size, message=str(e)[:1000])
            raise

    def ingest(self, source: str) -> list[dict]:
        """One file, or the files of a folder by name, each a run."""
        paths = [source] if source.endswith(".csv") else name_sorted(self.spark, source)
        return [self.ingest_file(p) for p in paths]

    def runs(self) -> DataFrame:
        """The last event of each run."""
        return self.store.latest("load_event", ["load_run_id"], "event_no").orderBy("load_run_id")

    def freshness(self) -> DataFrame:
        mart = self.store.read("mart_segment_allocation").agg(F.max("refreshed_at").alias("refreshed_at"))
        return mart.withColumn("hours", hours_between(F.current_timestamp(), "refreshed_at")).withColumn("state", freshness_state("hours"))

    def reject_report(self) -> DataFrame:
        return rules.reject_report(self.store.read("load_reject"))

    def raw_rows(self, source_file: str) -> DataFrame:
        """Facts of one file beside their staged rows, by line number: a line number is a
        key only together with its file and run."""
        fact = self.store.read("fact_person").where(F.col("source_file") == source_file).select("person_sk", "load_run_id", "source_row")
        staged = self.store.read("stg_adult").where(F.col("source_file") == source_file).select("load_run_id", "source_row", *COLUMNS.values())
        return fact.join(staged, ["load_run_id", "source_row"])

    def page(self) -> str:
        """The allocation mart as a dashboard page."""
        mart = serve.flag_labels(self.store.read("mart_segment_allocation").withColumnRenamed("occupation_is_assignable", "is_assignable")).orderBy(F.desc("candidates"), "occupation", "education_group")
        tiles, fresh = serve.tiles(mart).first().asDict(), self.freshness().first()
        return dashboard(mart.drop("refreshed_at"), "Segment allocation", ["occupation", "education_group"], list(tiles.items()), fresh["state"], fresh["hours"], ("mean_hours", "mean_capital_gain"))

    def lineage(self, limit: int = 3) -> DataFrame:
        fact = self.store.read("fact_person").where("capital_gain_is_topcoded or hours_per_week_is_topcoded or age_is_topcoded or duplicate_group_id is not null").select("person_sk", "record_key", "load_run_id", "source_file", "source_row")
        staged = self.store.read("stg_adult").select("record_key", *(F.col(c).alias(f"raw_{c}") for c in ("age", "hours_per_week", "capital_gain")))
        return fact.join(staged, "record_key").join(self.runs().select("load_run_id", "file_sha256"), "load_run_id").orderBy("person_sk").limit(limit)

    def check_quality(self, limit_hours: float = 168) -> tuple[DataFrame, bool]:
        """All assertions; the verdicts are kept with their time."""
        read = self.store.read
        n = lambda df: df.agg(F.count("*").alias("n"))
        suite = quality.Suite(self.spark)
        fact = lambda: read("fact_person")
        suite.expect_zero("record_key is unique", "unique", lambda: quality.unique(fact(), "record_key"))
        suite.expect_zero("person_sk is unique", "unique", lambda: quality.unique(fact(), "person_sk"))
        every = [d.name for d in DIMENSIONS] + ["education"]
        for d in every:
            suite.expect_zero(f"labels of dim_{d} are unique", "unique", lambda d=d: quality.unique(read(f"dim_{d}"), d))
        suite.expect_zero("no row is both loaded and quarantined", "unique", lambda: quality.disjoint(read("quarantine"), fact(), "record_key"))
        suite.expect_zero("no key is null", "complete", lambda: quality.complete(fact(), *(f"{d}_sk" for d in every)))
        for d in every:
            suite.expect_zero(f"{d}_sk resolves", "complete", lambda d=d: quality.resolves(fact(), f"{d}_sk", read(f"dim_{d}"), f"{d}_sk"))
        suite.expect_zero("lineage is present", "complete", lambda: quality.complete(fact(), "record_key", "load_run_id", "source_file", "source_row"))
        for c, s in SENTINELS.items():
            suite.expect_zero(f"{c}: a flag means no value", "valid", lambda c=c: n(fact().where(F.col(f"{c}_is_topcoded") & F.col(c).isNotNull())))
            suite.expect_zero(f"{c}: no sentinel is left", "valid", lambda c=c, s=s: n(fact().where(F.col(c) == s)))
        suite.expect_zero("age is in range", "valid", lambda: quality.within(fact(), "age", 1, 120))
        suite.expect_equal("flattened rows are the fact rows", "consistent", lambda: n(self.analytic()), lambda: n(fact()))
        both = lambda: n(fact().select("record_key").union(read("quarantine").select("record_key").distinct()))
        suite.expect_equal("staged = loaded + quarantined", "consistent", lambda: n(read("stg_adult")), both)
        suite.expect_zero("duplicate groups start at one", "consistent", lambda: quality.groups_start_at_one(fact(), "duplicate_group_id", "duplicate_seq"))
        suite.expect_zero("the last run is recent", "fresh", lambda: quality.fresh(self.runs().where("status = 'ok'"), "event_at", F.current_timestamp(), limit_hours))
        verdicts = suite.result()
        self.store.append("quality_check_result", verdicts.withColumn("checked_at", F.current_timestamp()))
        return verdicts, suite.passed


def _names(table: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in SCHEMAS[table].split(",")]
