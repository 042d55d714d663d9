"""Contract tables: what every parser's output is mapped to, and what reports are made of."""

from __future__ import annotations

ROWS = "array<array<string>>"
BBOX = "array<double>"
IMAGES = "array<struct<x0:double,x1:double,top:double,bottom:double>>"
ISSUES = "array<struct<severity:string,code:string,message:string>>"

RESULTS = "parser_name string, source_file string, success boolean, text string, markdown string, metadata map<string,string>, processing_time_seconds double, warnings array<string>, error string"
PAGES = "parser_name string, source_file string, page_number int, text string, markdown string, metadata map<string,string>"
ELEMENTS = f"parser_name string, source_file string, element_index int, type string, text string, page_number int, bbox {BBOX}, metadata map<string,string>"
TABLES = f"parser_name string, source_file string, table_index int, rows {ROWS}, page_number int, bbox {BBOX}, markdown string, html string, metadata map<string,string>"

#: One row for each file of an ingestion run; error is null where parsing succeeded, outputs where it failed.
INGESTION_LOG = (
    "source struct<file_name:string,relative_path:string,file_size_bytes:bigint,sha256:string>, document struct<page_count:int,table_count:int>, "
    "parser struct<name:string,conversion_status:string,status:string,processing_time_seconds:double>, outputs struct<json:string,markdown:string,text:string>, "
    "error struct<type:string,message:string>"
)


def columns(schema: str) -> list[str]:
    """Names of a flat DDL schema whose types hold no blank."""
    return [x.split(" ", 1)[0] for x in schema.split(", ")]
