"""A run that writes many named outputs, published together or not at all (A6-A8, registry A.4).

Every output is written into a staging folder named after the state of the input files; a note beside it (rows, schema,
format, data state) is written only after the data. When all are there, the staging folder is renamed to ``run-<id>`` with a
manifest, and ``CURRENT`` is replaced to name it. Readers follow ``CURRENT``, so they see the old run or the new one, never a
mixture. A run that was killed is resumed by running it again on the same inputs: outputs with a note are not computed a
second time, an output without one is written anew. Changed inputs give another id and start from nothing.

Rows are counted by an observed metric of the writing job. All file access goes through Hadoop's file system interface, so
the folder can lie in any store Spark writes to.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.materialize import input_state
from ..operators import align, binning, profile, progression, registers, target, topology, triage, validation
from ..operators import archetype as arch
from ..operators.features import RATE_DROP, log_parents, logged_rate_features
from ..sources.tables import write_table
from . import stages

Output = tuple[str, Callable[[], DataFrame]]


class Files:
    """Small file operations in the store of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.base = spark, folder.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        return self.spark.read.text(f"{self.base}/{name}", wholetext=True).first()[0]

    def write(self, name: str, text: str) -> None:
        """Written under another name and renamed, so a reader finds the whole text."""
        half = f"{name}.half"
        out = self.fs.create(self.path(half), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.delete(name)
        self.rename(half, name)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.path(old), self.path(new)):
            raise RuntimeError(f"{old} could not be renamed to {new}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def run_id(spark: SparkSession, inputs: list[str], outputs: dict[str, Output]) -> str:
    """Names the run by the state of its input files and the outputs asked for."""
    facts = [input_state(spark, sorted(inputs)), sorted((n, fmt) for n, (fmt, _) in outputs.items())]
    return hashlib.sha256(json.dumps(facts).encode()).hexdigest()[:16]


def write_run(spark: SparkSession, folder: str, inputs: list[str], outputs: dict[str, Output]) -> dict:
    """Write all ``outputs`` (name -> (format, function giving the frame)) and publish them; returns the manifest."""
    files, run = Files(spark, folder), run_id(spark, inputs, outputs)
    final, staging = f"run-{run}", f"_staging-{run}"
    if not files.exists(f"{final}/manifest.json"):
        notes = {}
        for name, (fmt, make) in outputs.items():
            note = f"{staging}/_notes/{name}.json"
            if not files.exists(note):
                watch = Observation(f"rows of {name}")
                df = make()
                write_table(df.observe(watch, F.count(F.lit(1)).alias("rows")), f"{files.base}/{staging}/{name}", fmt)
                files.write(note, json.dumps({"format": fmt, "rows": watch.get["rows"], "schema": df.schema.jsonValue()}))
            notes[name] = json.loads(files.read(note))
        files.write(f"{staging}/manifest.json", json.dumps(
            {"run": run, "inputs": input_state(spark, sorted(inputs)), "outputs": notes}, indent=4))
        files.rename(staging, final)
    files.write("CURRENT", final)
    return published(spark, folder)


def published(spark: SparkSession, folder: str) -> dict:
    """The manifest of the published run; raises where there is none."""
    files = Files(spark, folder)
    if not files.exists("CURRENT"):
        raise ValueError(f"nothing is published in {folder}")
    return json.loads(files.read(f"{files.read('CURRENT')}/manifest.json"))


def read_output(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An output of the published run, with the schema it was written with."""
    from pyspark.sql.types import StructType
    note = published(spark, folder)["outputs"][name]
    reader = spark.read.schema(StructType.fromJson(note["schema"])).format(note["format"])
    if note["format"] == "csv":
        reader = reader.option("header", True)
    return reader.load(f"{folder.rstrip('/')}/run-{published(spark, folder)['run']}/{name}")


# ------------------------------------------------------------------ the outputs of the analysis

def flat(df: DataFrame) -> DataFrame:
    """Lists and nested values as JSON text, for CSV."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])


def stage_outputs(spark: SparkSession, sf_dir: str) -> dict[str, Output]:
    """The tables of all stages by output name. A function builds its frame only when its output is to be written."""
    shared: dict = {}

    def once(key, make):
        if key not in shared:
            shared[key] = make()
        return shared[key]

    def mart():
        return stages.mart(spark, sf_dir)

    def logged():
        return once("logged", lambda: logged_rate_features(stages.cohort(mart())))

    def eng():
        return logged()[0]

    def churned():
        return stages.churned(eng())

    def model():
        return once("model", lambda: binning.fit_state_thresholds(churned()))

    def states():
        return binning.apply_states(churned(), binning.collect_thresholds(model()))

    def archetypes():
        return arch.assign_archetypes(states())

    def prevalence():
        return topology.state_dominance(topology.state_prevalence(states(), topology.state_columns(states())))

    def density():
        return topology.cooccurrence_density(topology.pair_counts(states(), topology.state_columns(states())), prevalence())

    def inf():
        return once("inf", lambda: stages.inferential(spark, sf_dir))

    def profiles():
        return align.population_profiles(inf())

    def alignment():
        return align.population_alignment(profiles(), align.reference_vector(inf(), stages.REFERENCE_PAIR))

    def summary():
        distances = align.population_mahalanobis(inf(), profiles(), align.reference_vector(inf(), stages.REFERENCE_PAIR),
                                                 stages.REFERENCE_PAIR)
        classes = align.structural_classes(profiles(), alignment()).select("population", "structural_classification")
        return align.comparison_summary(profiles(), alignment(), distances, classes,
                                        align.topology_summary(align.topology_rows(inf())))

    def target_of(df):
        return validation.discover(df, validation.detect_target(df))

    def register():
        return triage.triage_register(eng())

    def approved(name):
        return register().where(F.col("final_pathway_assignment") == name).select("feature")

    out = {
        "missingness_analysis": lambda: profile.missingness_by_outcome(mart()),
        "exposure_analysis": lambda: profile.exposure_mean_diff(mart()),
        "leakage_risk": lambda: registers.leakage_register(profile.missingness_by_outcome(mart())),
        "dominance_mapping": lambda: profile.mutual_information(mart(), registers.epistemic_lookup(mart())),
        "Engineered_Churn_Dataset": eng,
        "Feature_Transformation_Log": lambda: logged()[1].where("transformation <> 'dropped'"),
        "Feature_Mapping_Table": lambda: spark.createDataFrame(
            [(c, "engineered_or_retained") for c in eng().columns], "final_feature string, source string"),
        "Dropped_Feature_Registry": lambda: logged()[1].where(F.col("original_feature").isin(RATE_DROP)
                                                              & (F.col("transformation") == "dropped"))
        .select(F.col("original_feature").alias("dropped_feature"), "rows"),
        "Feature_Integrity_Table": lambda: validation.integrity_audit(eng(), target_of(eng())["log"],
                                                                      target_of(eng())["interaction"]),
        "Pathology_Correction_Summary": lambda: validation.pathology_delta(eng(), log_parents()),
        "Churn_Signal_Table": lambda: validation.signal_table(eng(), target_of(eng())["numeric"]),
        "Interaction_Evaluation_Table": lambda: validation.interaction_eval(eng(), target_of(eng())["interaction"],
                                                                            target_of(eng())["numeric"]),
        "Membership_Impact_Summary": lambda: validation.segment_separation(eng(), target_of(eng())["membership"],
                                                                           target_of(eng())["log"]),
        "Overall_Churn_Summary": lambda: target.overall_churn(target.standardise_target(eng())),
        "Segment_Churn_Table": lambda: target.segment_churn(eng()),
        "Imbalance_Summary": lambda: target.imbalance_summary(target.segment_churn(eng())),
        "Tenure_Geometry": lambda: target.tenure_geometry(eng()),
        "Behavioral_Separation": lambda: target.band_separation(eng()),
        "Baseline_Difficulty": lambda: target.baseline_rules(eng()),
        "Feature_Sensitivity_Map": lambda: target.lifecycle_relevance(target.tenure_geometry(eng())),
        "Feature_Triage_Register": register,
        **{f"{p.split(' ')[0].split('-')[0]}_Features".replace("/", "_"): lambda p=p: approved(p) for p in triage.PATHWAYS},
        "Tenure_Validation_Summary": lambda: triage.tenure_validation(eng()),
        "Churned_Population": churned,
        "Non_Churned_Population": lambda: stages.retained(eng()),
        "Predictive_Ready_Dataset": lambda: triage.predictive_ready(eng(), register()),
        "distribution_summary": lambda: model().drop("low_threshold", "high_threshold"),
        "state_constructed_dataset": states,
        "state_prevalence_summary": prevalence,
        "compound_interaction_matrix": density,
        "behavioral_archetype_dataset": archetypes,
        "behavioral_archetype_summary": lambda: arch.archetype_summary(archetypes()),
        "archetype_lifecycle_mapping": lambda: progression.lifecycle_positioning(archetypes()),
        "behavioral_decay_signatures": lambda: progression.decay_signatures(archetypes()),
        "instability_profiles": lambda: progression.instability_profiles(archetypes()),
        "latent_progression_topology": lambda: progression.progression_topology(archetypes()),
        "reference_structure_statistics": lambda: align.reference_statistics(inf(), stages.REFERENCE_PAIR),
        "population_structure_profiles": profiles,
        "population_alignment_matrix": alignment,
        "population_topology": lambda: align.topology_summary(align.topology_rows(inf())),
        "silhouette": lambda: align.silhouette(align.scaled_rows(inf())),
        "structural_classes": lambda: align.structural_classes(profiles(), alignment()),
        "comparison_summary": summary,
        "final_structural_synthesis": lambda: align.final_synthesis(summary()),
    }
    nested = {
        "statistical_thresholds": lambda: model().select("feature", "low_threshold", "high_threshold"),
        "state_mapping_logic": lambda: binning.state_mapping_logic(model()),
        "dominant_states": lambda: topology.dominant_states(prevalence()),
        "concentration_metrics": lambda: topology.concentration_metrics(prevalence()),
        "high_density_zones": lambda: topology.high_density_zones(density()),
        "state_mix": lambda: progression.state_mix(archetypes()),
        "comparison_summary_json": summary,
    }
    return ({n: ("csv", lambda f=f: flat(f())) for n, f in out.items()} | {n: ("json", f) for n, f in nested.items()})


def write_stage_outputs(spark: SparkSession, sf_dir: str, folder: str) -> dict:
    """All outputs of the analysis over the tables in ``sf_dir``, published in ``folder``."""
    base = sf_dir.rstrip("/")
    return write_run(spark, folder, [f"{base}/{t}.parquet" for t in stages.MART_TABLES], stage_outputs(spark, sf_dir))
