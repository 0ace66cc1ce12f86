"""The canonical tables as DDL: flat, keyed by doc_id, with explicit order columns."""

from pyspark.sql import types as T


def schema(ddl: str) -> T.StructType:
    """The DDL parsed, which needs a session."""
    return T.StructType.fromDDL(ddl)


LOCATOR = "struct<format: string, source_file: string, page_start: int, page_end: int, bboxes: array<array<double>>, sheet_name: string, cell_range: string, slide_number: int, shape_id: string, shape_ids: array<string>, section_index: int, element_start: int, element_end: int, row_start: int, row_end: int, json_path: string, mime_part: string, element_index: int, element_id: string>"
FILES = "path STRING, length BIGINT, content BINARY, sha256 STRING, fmt STRING"
ELEMENTS = f"doc_id BIGINT, id STRING, parent_id STRING, ordinal INT, type STRING, content STRING, heading_path ARRAY<STRING>, engine STRING, confidence DOUBLE, source_locator {LOCATOR}, locator_precision STRING, table_id STRING, properties MAP<STRING, STRING>"
TABLES = f"doc_id BIGINT, table_id STRING, source_format STRING, source_locator {LOCATOR}, n_rows INT, n_columns INT, merged BOOLEAN, engine STRING, confidence DOUBLE"
CELLS = "doc_id BIGINT, table_id STRING, row INT, column INT, value STRING, rowspan INT, colspan INT, is_header BOOLEAN"
CHUNKS = "doc_id BIGINT, chunk_id STRING, chunk_index INT, part_index INT, part_count INT, heading_path ARRAY<STRING>, element_ids ARRAY<STRING>, text STRING, char_count INT, context_prefix STRING, embedding_text STRING"
EDGES = "doc_id BIGINT, src STRING, relation STRING, dst STRING, confidence DOUBLE, evidence ARRAY<STRING>, method STRING"
WARNINGS = "doc_id BIGINT, code STRING, message STRING, evidence STRING"
OCR_BOXES = "doc_id BIGINT, page INT, idx INT, x DOUBLE, y DOUBLE, text STRING, conf DOUBLE"
BLOCKS = "doc_id BIGINT, page INT, idx INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, text STRING"
