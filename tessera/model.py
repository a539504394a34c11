"""Keyword classes and row types of the schema model."""

from __future__ import annotations

# Fixed values, to the end of SYMBOLIC: the default keyword classes of the modelling language.
STRUCTURAL = (
    "namespace", "import", "revision", "module", "grouping", "container", "uses", "type", "list", "leaf", "augment", "deviation", "deviate",
    "leaf-list", "choice", "case", "rpc", "identity", "typedef", "action", "anydata", "anyxml", "enum", "bit", "extension", "argument",
)
CONSTRAINT = (
    "range", "length", "mandatory", "status", "config", "min-elements", "max-elements", "fraction-digits", "must", "when", "pattern",
    "if-feature", "ordered-by", "yin-element", "default", "require-instance",
)
ATTRIBUTE = (
    "name", "path", "value", "base", "organization", "contact", "description", "prefix", "include", "units", "reference", "yang-version",
    "presence", "key", "unique", "error-message",
)
ALWAYS_CONSTRAINT = ("when", "must", "if-feature")
BY_PATH = ("augment", "deviation")
SYMBOLIC = ("enum", "bit")
TEMPLATE = ("grouping",)

# The built-in types of the modelling language.
BUILTIN = (
    "binary", "bits", "boolean", "decimal64", "empty", "enumeration", "identityref", "instance-identifier", "int8", "int16", "int32", "int64", "leafref", "string", "uint8", "uint16",
    "uint32", "uint64", "union",
)

STATEMENT = "file string, module string, stmt_id int, parent_id int, ord int, depth int, prefix string, keyword string, arg string, line int, trail array<string>"
NODE = "file string, module string, node_id int, path string, keyword string, name string, type_name string, line int, grouping string, rel_path string, uses string, type_json string, target string, last_id int"
PROPERTY = "file string, node_id int, kind string, field string, pos int, value string"
