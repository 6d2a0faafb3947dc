"""Schemas of the data model, as DDL. Nullable extras of variants are plain nullable columns."""

BOX = "STRUCT<x1:DOUBLE,y1:DOUBLE,x2:DOUBLE,y2:DOUBLE>"
DOCUMENTS = "doc_id STRING, company STRING, fiscal_year STRING, source_path STRING"
PAGES = "doc_id STRING, page INT, text STRING, word_count INT, char_count INT, extraction_method STRING, needs_ocr BOOLEAN, error STRING, ocr_config STRING"
WORDS = "doc_id STRING, page INT, word_idx INT, text STRING, x0 DOUBLE, x1 DOUBLE, top DOUBLE, bottom DOUBLE"  # page_height DOUBLE may follow
OBJECTS = "doc_id STRING, page INT, kind STRING, x0 DOUBLE, top DOUBLE, x1 DOUBLE, bottom DOUBLE"
LAYOUT_BLOCKS = f"doc_id STRING, page_num INT, block_id INT, type STRING, confidence DOUBLE, bounding_box {BOX}, word_count INT, rows INT, cols INT, text STRING"
TABLE_INDEX = "filename STRING, method STRING, page INT, rows INT, cols INT, accuracy DOUBLE, content_quality DOUBLE, financial_score INT"
TABLE_META = "doc_id STRING, page INT, table_num INT, method STRING, rows INT, cols INT, accuracy DOUBLE, content_quality DOUBLE, financial_score INT"
CELLS = "doc_id STRING, method STRING, page INT, table_num INT, row_idx INT, col_idx INT, header STRING, value STRING"
RECORDS = (
    "doc_id STRING, company STRING, fiscal_year STRING, source_path STRING, extraction_timestamp TIMESTAMP, page INT, section STRING, block_type STRING, text STRING, extraction_method STRING, confidence DOUBLE, "
    f"bbox {BOX}, "
    "table_info STRUCT<rows:INT,cols:INT,table_id:INT,extraction_method:STRING,file_name:STRING,has_headers:BOOLEAN>, "
    "image_info STRUCT<width:INT,height:INT,format:STRING,alt_text:STRING>, "
    "layout_info STRUCT<font_size:DOUBLE,font_family:STRING,is_bold:BOOLEAN,is_italic:BOOLEAN,text_color:STRING,background_color:STRING>, "
    "section_info STRUCT<title:STRING,level:INT,content_length:INT,section_number:INT>, "
    "ai_analysis STRUCT<model_name:STRING,analysis_type:STRING,entities_detected:ARRAY<STRING>,sentiment_score:DOUBLE,topics:ARRAY<STRING>>"
)
FACTS = "source_file STRING, concept STRING, namespace STRING, value_text STRING, numeric_value DOUBLE, context_id STRING, unit STRING, currency STRING, decimals STRING, precision STRING, period_type STRING, start_date DATE, end_date DATE, instant_date DATE, segment STRING, entity STRING"
MAPPINGS = "label STRING, clean_label STRING, concept STRING, confidence DOUBLE, method STRING, mapped BOOLEAN"
DISCREPANCIES = "label STRING, concept STRING, pdf_value DOUBLE, fact_value DOUBLE, difference DOUBLE, percentage_difference DOUBLE, scaled_match BOOLEAN, scale_factor DOUBLE, discrepancy_type STRING, severity STRING"
METRIC_HISTORY = "id STRING, ts TIMESTAMP, source STRING, metric STRING, value DOUBLE"
BASELINES = "name STRING, metric STRING, value DOUBLE, created TIMESTAMP, source_id STRING"
ALERTS = "metric STRING, baseline DOUBLE, current DOUBLE, relative_change DOUBLE, threshold DOUBLE, severity STRING, baseline_source STRING, ts TIMESTAMP"
STAGE_METRICS = "stage STRING, processing_time_seconds DOUBLE, files_processed INT, success_rate DOUBLE, output_size_mb DOUBLE, memory_usage_mb DOUBLE, error STRING"
RUNS = "run_id STRING, ts TIMESTAMP, run_directory STRING, status STRING, summary STRING"
BENCH_RESULTS = "operation STRING, runtime_seconds DOUBLE, memory_peak_mb DOUBLE, memory_baseline_mb DOUBLE, cpu_percent_avg DOUBLE, pages_processed INT, success_count INT, failure_count INT"
_ELEMENT = "STRUCT<element_type:STRING,text:STRING,confidence:DOUBLE,bounding_poly:STRUCT<vertices:ARRAY<STRUCT<x:DOUBLE,y:DOUBLE>>>,orientation:INT>"
_CELL = f"STRUCT<text:STRING,row_span:INT,col_span:INT,layout:{_ELEMENT}>"
OCR_DOCUMENTS = (
    "text STRING, pages ARRAY<STRUCT<page_number:INT,dimensions:STRUCT<width:DOUBLE,height:DOUBLE,unit:STRING>,"
    f"blocks:ARRAY<{_ELEMENT}>,paragraphs:ARRAY<{_ELEMENT}>,lines:ARRAY<{_ELEMENT}>,tokens:ARRAY<{_ELEMENT}>,"
    f"tables:ARRAY<STRUCT<table_id:INT,header_rows:ARRAY<ARRAY<{_CELL}>>,body_rows:ARRAY<ARRAY<{_CELL}>>,layout:{_ELEMENT}>>,"
    f"form_fields:ARRAY<STRUCT<field_name:STRING,field_value:STRING,name_layout:{_ELEMENT},value_layout:{_ELEMENT}>>>>, "
    "entities ARRAY<STRUCT<type:STRING,mention_text:STRING,normalized_value:STRING,confidence:DOUBLE,page_refs:ARRAY<STRUCT<page:INT,layout_type:STRING,layout_id:STRING>>>>"
)
