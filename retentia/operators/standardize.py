"""Standardised records: every normalizer of the record model as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions import scalars as S

#: Header of the summary layout, in order.
SUMMARY_HEADER = [
    "Paper", "DOI", "Publication Year", "Corresponding Author", "Email", "Physical Address", "Analyte Polymer", "Critical Component", "Architecture",
    "Critical Condition Basis", "Column Name", "Stationary Phase Chemistry", "Column Mode", "Pore Size", "Column Dimensions", "Mobile Phase Solvents",
    "Mobile Phase Ratio", "Mobile Phase Ratio Units", "Aqueous pH", "Aqueous Salt Added", "Aqueous Salt Type", "Aqueous Salt Concentration", "Temperature (°C)",
    "Flow Rate", "Detector", "Consensus Confidence", "Qwen Confidence", "Mistral Confidence", "Evidence: Critical Condition", "Evidence: Critical Component",
    "Evidence: Column Name", "Evidence: Mobile Phase Solvents", "Evidence: Mobile Phase Ratio", "Evidence: Temperature", "Evidence: Pore Size", "Evidence: Flow Rate", "Notes",
]
#: Header of the standardised layout, in order.
STANDARD_HEADER = [
    "Paper", "DOI", "Publication Year", "Corresponding Author", "Email", "Physical Address", "Analyte Polymer", "Critical Component", "Architecture (Raw)", "Architecture",
    "Critical Condition Basis", "Column Name", "Stationary Phase Chemistry", "Column Mode", "Pore Size (Raw)", "Pore Size (Angstrom)", "Pore Size Min (Angstrom)",
    "Pore Size Max (Angstrom)", "Column Dimensions", "Mobile Phase Solvents", "Mobile Phase Ratio (Raw)", "Mobile Phase Ratio Components", "Mobile Phase Ratio Min",
    "Mobile Phase Ratio Max", "Mobile Phase Ratio Units (Raw)", "Mobile Phase Ratio Units", "Aqueous pH", "Aqueous pH Modifier", "Aqueous Salt Added", "Aqueous Salt Type",
    "Aqueous Salt Concentration", "Temperature (°C) (Raw)", "Temperature (°C)", "Temperature Min (°C)", "Temperature Max (°C)", "Flow Rate (Raw)", "Flow Rate (mL/min)",
    "Flow Rate Min (mL/min)", "Flow Rate Max (mL/min)", "Detector", "Consensus Confidence", "Qwen Confidence", "Mistral Confidence", "Evidence Text", "Notes",
]


def standardize(records: DataFrame) -> DataFrame:
    """Raw values kept beside typed ones; the pore size's number-or-list becomes two columns."""
    c = F.col
    ratio, flow, pore, temp = S.ratio_parts(c("mobile_phase_ratio")), S.flow_rate(c("flow_rate")), S.pore_size(c("pore_size")), S.temperature(c("temperature_celsius"))
    arch = S.architecture(c("architecture"))
    solvents, modifier = S.solvents_and_modifier(c("mobile_phase_solvents"))
    aq = c("aqueous_parameters")
    wide = records.select("*", ratio.alias("_ratio"), flow.alias("_flow"), pore.alias("_pore"), temp.alias("_temp"), arch.alias("_arch"), modifier.alias("_mod"))
    return wide.select(
        *[k for k in records.columns if k not in ("mobile_phase_ratio_units", "mobile_phase_ratio", "flow_rate", "pore_size", "temperature_celsius", "column_mode", "architecture", "mobile_phase_solvents", "aqueous_parameters", "publication_year")],
        c("mobile_phase_ratio_units").alias("mobile_phase_ratio_units_raw"), S.ratio_units(c("mobile_phase_ratio_units")).alias("mobile_phase_ratio_units"),
        c("mobile_phase_ratio").alias("mobile_phase_ratio_raw"), c("_ratio.components").alias("mobile_phase_ratio_components"), c("_ratio.lo").alias("mobile_phase_ratio_min"), c("_ratio.hi").alias("mobile_phase_ratio_max"),
        c("flow_rate").alias("flow_rate_raw"), c("_flow.value").alias("flow_rate_ml_per_min"), c("_flow.lo").alias("flow_rate_min_ml_per_min"), c("_flow.hi").alias("flow_rate_max_ml_per_min"),
        c("pore_size").alias("pore_size_raw"), c("_pore.value").alias("pore_size_angstrom"), c("_pore.list").alias("pore_size_angstrom_list"), c("_pore.lo").alias("pore_size_min_angstrom"), c("_pore.hi").alias("pore_size_max_angstrom"),
        c("temperature_celsius").alias("temperature_raw"), c("_temp.value").alias("temperature_celsius"), c("_temp.lo").alias("temperature_min_celsius"), c("_temp.hi").alias("temperature_max_celsius"),
        S.column_mode(c("column_mode")).alias("column_mode"), F.when(~c("architecture").eqNullSafe(c("_arch")), c("architecture")).alias("architecture_raw"), c("_arch").alias("architecture"),
        solvents.alias("mobile_phase_solvents"),
        F.when(c("_mod").isNotNull() | aq.isNotNull(), F.struct(aq["pH"].alias("pH"), aq["salt_added"].alias("salt_added"), aq["salt_type"].alias("salt_type"), aq["salt_concentration"].alias("salt_concentration"), F.coalesce(c("_mod"), aq["pH_modifier"]).alias("pH_modifier"))).alias("aqueous_parameters"),
        S.year(c("publication_year")).alias("publication_year"),
    )


def fingerprint(row: dict[str, Column]) -> Column:
    """Key of a summary row: paper, phase, column, families of component and analyte, rounded leading numbers of ratio and temperature; no solvents."""
    n = lambda x: F.coalesce(F.bround(S.leading_number(row[x]), 0).cast("string"), F.lit(""))
    texts = {"paper": "Paper", "spc": "Stationary Phase Chemistry", "col": "Column Name"}
    return F.struct(*[S.norm(row[h]).alias(k) for k, h in texts.items()], *[S.canonical_polymer(S.norm(row[h])).alias(k) for k, h in (("cc", "Critical Component"), ("ap", "Analyte Polymer"))], n("Mobile Phase Ratio").alias("r"), n("Temperature (°C)").alias("t"))


def filled_cells(row: dict[str, Column]) -> Column:
    """How many of the 37 cells say something; a salt that was not added does not."""
    return sum((F.when((v != "") & ((v != "false") if h == "Aqueous Salt Added" else F.lit(True)), 1).otherwise(0) for h, v in row.items()), F.lit(0))


def fingerprint_dedup(records: DataFrame, order: str = "record_id") -> DataFrame:
    """One row per fingerprint of the cleaned summary cells: the fullest, ties the earliest; `first_pos` is the place of the first row of the group.

    max/min of small structs instead of a window: merged map-side, so a fingerprint shared by a third of the rows is no task of its own.
    """
    row = summary_cells()
    best = records.select(order, fingerprint(row).alias("fp"), filled_cells(row).alias("filled"))
    rank = F.struct("filled", (-F.col(order)).alias("neg"))
    return best.groupBy("fp").agg(F.max(rank).alias("b"), F.min(order).alias("first_pos"), F.count("*").alias("n")).select((-F.col("b.neg")).alias(order), F.col("b.filled").alias("filled"), "first_pos", "n")


def summary_cells() -> dict[str, Column]:
    """The 37 cells of the summary layout by their header, '' for every missing text."""
    c, t = F.col, S.clean_text
    ev, aq, mc = c("field_evidence"), c("aqueous_parameters"), c("model_confidences")
    values = [
        F.coalesce("paper_id", F.lit("")), t(c("paper_doi")), t(c("publication_year")), t(c("corresponding_author_name")), t(c("corresponding_email_address")), t(c("physical_address")), t(c("analyte_polymer")), t(c("critical_component")), t(c("architecture")),
        t(c("critical_condition_basis")), t(c("column_name")), t(c("stationary_phase_chemistry")), t(c("column_mode")), t(c("pore_size")), t(c("column_dimensions")), t(F.array_join("mobile_phase_solvents", ", ")),
        t(c("mobile_phase_ratio")), t(c("mobile_phase_ratio_units")), t(aq["pH"]), S.shown(aq["salt_added"]), t(aq["salt_type"]), t(aq["salt_concentration"]), t(c("temperature_celsius")), t(c("flow_rate")), t(c("detector")), t(c("critical_condition_confidence")),
        t(mc["qwen"]), t(mc["mistral"]), *[t(ev[k]) for k in ("critical_condition_basis", "critical_component", "column_name", "mobile_phase_solvents", "mobile_phase_ratio", "temperature_celsius", "pore_size", "flow_rate")], t(c("notes")),
    ]
    return dict(zip(SUMMARY_HEADER, values))


def summary_rows(records: DataFrame) -> DataFrame:
    """The 37 columns of the summary layout."""
    return records.select(*[v.alias(n) for n, v in summary_cells().items()])


def standard_rows(standardized: DataFrame) -> DataFrame:
    """The 45 columns of the standardised layout, everything as text."""
    c, t = F.col, S.clean_text
    joined = lambda x: F.coalesce(F.array_join(x.cast("array<string>"), ", "), F.lit(""))
    aq, mc, ev = c("aqueous_parameters"), c("model_confidences"), c("field_evidence")
    values = [
        c("paper_id"), t(c("paper_doi")), S.shown(c("publication_year")), t(c("corresponding_author_name")), t(c("corresponding_email_address")), t(c("physical_address")), t(c("analyte_polymer")), t(c("critical_component")), t(F.coalesce("architecture_raw", "architecture")), S.shown(c("architecture")),
        t(c("critical_condition_basis")), t(c("column_name")), t(c("stationary_phase_chemistry")), S.shown(c("column_mode")), t(c("pore_size_raw")), F.when(c("pore_size_angstrom").isNotNull(), S.shown(c("pore_size_angstrom"))).otherwise(joined(c("pore_size_angstrom_list"))), S.shown(c("pore_size_min_angstrom")), S.shown(c("pore_size_max_angstrom")),
        t(c("column_dimensions")), joined(c("mobile_phase_solvents")), t(c("mobile_phase_ratio_raw")), joined(c("mobile_phase_ratio_components")), S.shown(c("mobile_phase_ratio_min")), S.shown(c("mobile_phase_ratio_max")), t(c("mobile_phase_ratio_units_raw")), S.shown(c("mobile_phase_ratio_units")),
        t(aq["pH"]), t(aq["pH_modifier"]), S.shown(aq["salt_added"]), t(aq["salt_type"]), t(aq["salt_concentration"]), F.when(c("temperature_min_celsius").isNotNull(), t(c("temperature_raw"))).otherwise(S.shown(c("temperature_celsius"))), S.shown(c("temperature_celsius")), S.shown(c("temperature_min_celsius")), S.shown(c("temperature_max_celsius")),
        t(c("flow_rate_raw")), S.shown(c("flow_rate_ml_per_min")), S.shown(c("flow_rate_min_ml_per_min")), S.shown(c("flow_rate_max_ml_per_min")), t(c("detector")), t(c("critical_condition_confidence")), t(mc["qwen"]), t(mc["mistral"]), F.concat_ws(" | ", *[ev[k] for k in ("critical_condition_basis", "critical_component", "column_name", "mobile_phase_solvents", "mobile_phase_ratio", "temperature_celsius", "pore_size", "flow_rate")]), t(c("notes")),
    ]
    return standardized.select(*[v.alias(n) for v, n in zip(values, STANDARD_HEADER)])
