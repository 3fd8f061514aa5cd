"""Schemas of the tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "array<float>": T.ArrayType(T.FloatType()), "array<int>": T.ArrayType(T.IntegerType())}


def _of(fields: str) -> T.StructType:
    """From "name type, name type"; unlike ``fromDDL`` this needs no session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (field.split() for field in fields.split(","))])


CHUNKS = _of(
    "chunk_id string, text string, source_document string, document_title string, organization string, source_url string, document_type string, ocr_derived boolean, "
    "chunk_type string, disease_name string, disease_name_is_canonical boolean, source_disease_label string, section string, page_start int, page_end int, word_count int, "
    "chunk_index int, chunk_total int, is_inoculation_protocol boolean, symptom string, recommended_treatment string, active_ingredient string, dosage string, crop_stage string"
)
CHUNK_VECTORS = _of("chunk_id string, vector array<float>")
LAYOUT_LINES = _of("filename string, page int, page_width double, page_height double, line_no int, x0 double, y0 double, x1 double, y1 double, size double, text string")
LAYOUT_WORDS = _of("filename string, page int, word_no int, x0 double, y0 double, x1 double, y1 double, word string")
PAGES = _of("filename string, page int, width double, height double, text string, image_count int")
DOCUMENTS = _of("filename string, page_count int, producer string, meta_title string, meta_author string")
TABLE_REGIONS = _of("filename string, page int, table_id string, caption_marker string, drop_y_start double, drop_y_end double")
SECTIONS = _of("filename string, section_index int, heading string, text string, word_count int, page_start int, page_end int")
FIGURE_CAPTIONS = _of("filename string, caption_index int, page int, text string")
MANIFEST_OVERRIDES = _of("filename string, verified_title string, organization string, document_type string, has_parent_work boolean, parent_work string, source_url string, warning string, ignore_embedded_metadata_title boolean")
MANIFEST_PARENTS = _of("parent_work string, organization string, source_url string")
RETRIEVAL_REQUESTS = _of("request_id string, query_vector array<float>, disease_name string, intent string, top_k int")
VERIFIED_RECORD = _of(
    "fungicide string, active_ingredient string, rate_per_acre string, cultivar_reaction string, percent_positive_stops string, percent_infected_tillers string, "
    "comments string, disease_name string, source_disease_label string"
)
VERIFIED_TABLES = _of("table_id string, page int, caption string, disease_name string").add("records", T.ArrayType(VERIFIED_RECORD))
ANCHORS = _of("image_index int, anchor_id int, cx float, cy float, w float, h float, class_scores array<float>, coeffs array<float>")
IMAGES = _of("image_index int, filename string, orig_w int, orig_h int, scale double, pad_x double, pad_y double")
MASKS = _of("image_index int, det_id int, class_name string, size array<int>, counts array<int>")
SPIKE_SCORES = _of("request_id string, image_index int, filename string, score double")

_SPAN = T.StructType([T.StructField("text", T.StringType()), T.StructField("size", T.DoubleType())])
_LINE = T.StructType([T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("spans", T.ArrayType(_SPAN))])
#: Pages as parsers give them: blocks of lines of spans.
NESTED_PAGES = _of("filename string, page int, page_width double, page_height double").add("blocks", T.ArrayType(T.StructType([T.StructField("lines", T.ArrayType(_LINE))])))

ALL = {name.lower(): value for name, value in list(globals().items()) if isinstance(value, T.StructType)}
