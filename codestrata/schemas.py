"""Schemas of the tables that make up a code graph and an architecture (M1-M14). Never inferred."""

import re


class Schema(str):
    """A schema in DDL, as Spark takes it anywhere; it needs no session to exist."""

    @property
    def names(self) -> list[str]:
        flat = str(self)
        while (cut := re.sub(r"<[^<>]*>", "", flat)) != flat:
            flat = cut
        return [part.split()[0] for part in flat.split(",")]


def _schema(text: str) -> Schema:
    return Schema(text)


ENTITIES = _schema(
    "fqn STRING, name STRING, package STRING, file_path STRING, kind STRING, language STRING, imports ARRAY<STRING>, superclass STRING,"
    " interfaces ARRAY<STRING>, owner STRING, is_data BOOLEAN, is_sealed BOOLEAN, import_aliases MAP<STRING, STRING>, entity_seq BIGINT"
)
EDGES = _schema("source STRING, target STRING, relation STRING, edge_seq BIGINT")
PACKAGES = _schema("package STRING, fqn STRING, pos BIGINT")
COMPONENTS = _schema("comp_seq INT, name STRING, responsibility STRING")
MEMBERSHIP = _schema("fqn STRING, comp_seq INT, name STRING, member_pos BIGINT")
METRICS = _schema("name STRING, value DOUBLE")
METRIC_DETAILS = _schema("metric STRING, component STRING, value DOUBLE")
SMELLS = _schema("smell_type STRING, severity STRING, affected ARRAY<STRING>, description STRING, explanation STRING, suggestion STRING, detector_seq INT")
SOURCE_FILES = _schema("path STRING, rel_path STRING, ext STRING, language STRING, length BIGINT, modified TIMESTAMP")
FACTS = _schema(
    "rel_path STRING, language STRING, package STRING, entities ARRAY<STRUCT<fqn STRING, name STRING, kind STRING, imports ARRAY<STRING>,"
    " superclass STRING, interfaces ARRAY<STRING>, owner STRING, is_data BOOLEAN, is_sealed BOOLEAN, refs ARRAY<STRING>>>,"
    " imports ARRAY<STRUCT<module STRING, names ARRAY<STRING>>>, aliases MAP<STRING, STRING>, error STRING"
)
SNAPSHOT = _schema(
    "repo_name STRING, commit_sha STRING, algorithm STRING, num_components BIGINT, num_entities BIGINT, num_edges BIGINT, source_num_entities BIGINT,"
    " class_count BIGINT, function_count BIGINT, method_count BIGINT, component_dependencies ARRAY<STRUCT<source STRING, target STRING>>,"
    " components ARRAY<STRUCT<name STRING, responsibility STRING, num_entities BIGINT, class_count BIGINT, function_count BIGINT, method_count BIGINT,"
    " entity_kind_counts MAP<STRING, BIGINT>, entities ARRAY<STRING>>>, metrics MAP<STRING, DOUBLE>,"
    " smells ARRAY<STRUCT<smell_type STRING, severity STRING, affected ARRAY<STRING>, description STRING>>"
)
