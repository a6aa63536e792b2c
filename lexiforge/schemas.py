"""Schemas of the engine's inputs and outputs. Nothing is inferred."""

from __future__ import annotations

DICTIONARY_RAW = "row long, name string"
POLLUTANTS_RAW = "row long, canonical string, synonyms string"
TERMS = "term string"
SYNONYMS = "seq long, synonym_raw string"
SYNONYM_MAP = "synonym string, canonical string"
TOKENS = "doc_id string, tokens array<string>"
BOXES = "image_id string, box_id int, polygon array<struct<x:double,y:double>>, text string, level double"
GROUND_TRUTH = "id string, image_name string, extracted_barcode string, brand string, product_name string, model string, inci_list array<string>, raw_ingredients_list string"
VECTORS = "name string, id long, token string, embedding array<float>"
RESULT = "doc_id string, ingredients array<string>, pollutants array<string>"
METRICS = "image_id string, method string, tp long, fp long, fn long, precision double, recall double, f1 double, tp_rate double"
RUN_INFO = "run_id string, method string, accuracy double, f1_score double, config map<string,string>"
