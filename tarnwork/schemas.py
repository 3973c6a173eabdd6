"""Schemas of the canonical tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def schema(ddl: str) -> T.StructType:
    """From ``name type`` pairs, so that reserved words need no quoting."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (p.split() for p in ddl.split(","))])


REPORT = schema(
    "report_id string, perturbation_id string, perturbation_type string, perturbation_label string, symptom string, relation string, evidence_class string, source string, report_value long, "
    "source_record_id string, source_record_label string, source_term_id string, source_term_label string, evidence_code string, model_description string, frequency double, frequency_denominator int, "
    "placebo_flag boolean, onset string, sex string, references string, pubmed_reference_count long, evidence_date string, rubric_log_sample_size double, rubric_frequency_known double, "
    "rubric_evidence_code_pcs double, rubric_evidence_code_tas double, rubric_evidence_code_iea double, rubric_placebo_controlled double, rubric_curated_synopsis double, limitations string, "
    "perturbation_nodes string, association_type string, rubric_causal_association double, evidence_date_source string"
)
NODE = schema(
    "node_id string, node_type string, display_name string, compartment string, is_currency boolean, degree long, gene_symbol string, ensembl_gene_id string, in_metabolic_layer boolean, is_transport boolean, "
    "reversible boolean, gene_reaction_rule string, subsystem string, base_metabolite_id string, brain_median_tpm_max double, brain_expressed boolean"
)
EDGE = schema("source_id string, target_id string, relation_type string, sign double, evidence_source string, stoichiometric_coefficient double, weight double")
SELECTION = schema("perturbation_id string, symptom string, keep boolean, reason string, counts_as_negative boolean, masks_a_negative boolean")
