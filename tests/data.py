"""Small record tables for the tests."""

RECORD_DDL = (
    "record_id bigint, load_id bigint, loaded_at timestamp, paper_id string, subfolder string, model string, cond_idx int, run_ts timestamp, file_name string, analyte_polymer string, critical_component string, "
    "architecture string, critical_condition_basis string, critical_condition_confidence string, column_name string, stationary_phase_chemistry string, column_mode string, mobile_phase_solvents array<string>, "
    "mobile_phase_ratio string, mobile_phase_ratio_units string, aqueous_parameters struct<pH:string,salt_added:boolean,salt_type:string,salt_concentration:string,pH_modifier:string>, temperature_celsius string, "
    "flow_rate string, pore_size string, column_dimensions string, detector string, field_evidence struct<critical_condition_basis:string,critical_component:string,column_name:string,mobile_phase_solvents:string,"
    "mobile_phase_ratio:string,temperature_celsius:string,pore_size:string,flow_rate:string>, notes string, paper_doi string, corresponding_author_name string, corresponding_email_address string, "
    "physical_address string, publication_year string, model_confidences struct<qwen:string,mistral:string>"
)
#: Names that operators use inside; a table may bring them along.
CLASHES = ["root", "form", "salt", "id", "scope", "field", "pos", "value", "raw", "load", "n", "row_id", "text", "x", "lo", "hi", "first_id", "tokens", "ids", "counts"]


def records(spark, rows):
    """Rows as dicts; everything not given is null."""
    from pyspark.sql import types as T

    schema = T._parse_datatype_string(RECORD_DDL)
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES if c not in df.columns])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
