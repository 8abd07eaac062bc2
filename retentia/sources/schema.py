"""One explicit superset schema; nothing is inferred from files."""

EVIDENCE = "struct<critical_condition_basis:string,critical_component:string,column_name:string,mobile_phase_solvents:string,mobile_phase_ratio:string,temperature_celsius:string,pore_size:string,flow_rate:string>"
AQUEOUS = "struct<pH:string,salt_added:boolean,salt_type:string,salt_concentration:string,pH_modifier:string>"
RECORD = (
    "struct<analyte_polymer:string,critical_component:string,architecture:string,critical_condition_basis:string,critical_condition_confidence:string,column_name:string,"
    "stationary_phase_chemistry:string,column_mode:string,mobile_phase_solvents:array<string>,mobile_phase_ratio:string,mobile_phase_ratio_units:string,"
    f"aqueous_parameters:{AQUEOUS},temperature_celsius:string,flow_rate:string,pore_size:string,column_dimensions:string,detector:string,field_evidence:{EVIDENCE},evidence_text:string,"
    "notes:string,paper_doi:string,corresponding_author_name:string,corresponding_email_address:string,physical_address:string,publication_year:string,"
    "model_confidences:struct<qwen:string,mistral:string>,source_model:string>"
)
CHUNK_DETAIL = "struct<chunk_index:int,section:string,token_count:bigint,extraction_success:boolean,processing_time:double,extracted_count:int,error:string>"
METADATA = "struct<source_pdf:string,extraction_date:string,model:string,inputs:array<string>>"
ENVELOPE = f"metadata {METADATA}, summary struct<total_conditions:int>, extracted_data struct<conditions:array<{RECORD}>>, final_consensus struct<extracted_conditions:array<{RECORD}>>, chunk_details array<{CHUNK_DETAIL}>, _corrupt_record string"
CALL = "struct<call_type:string,input_tokens:bigint,output_tokens:bigint,duration_s:double,success:boolean,error:string>"
TELEMETRY = f"paper_name string, model string, phase string, wall_start string, wall_end string, wall_duration_s double, initial_calls int, retry_calls int, total_calls int, total_input_tokens bigint, total_output_tokens bigint, total_tokens bigint, call_log array<{CALL}>, conditions_extracted int, pytorch_peak_gb double, gpu_delta_mb double, num_chunks int, success boolean, error string, conditions_per_minute double, tokens_per_second double"
