"""JSON texts whose objects may repeat a key: the last one counts, as for most readers.

Variants refuse such texts, typed maps keep all entries in their order; so what an object holds is read as a
map, and whether the text is JSON at all is judged apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetscope.functions.text import let

_CORRUPT = {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}
#: Texts of JSON values that are no strings.
_NO_STRING = r"(?s)^(?:-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|[\[{].*)$"

MEMBER = "struct<key:string,text:string,is_string:boolean>"


def malformed_json(content: Column) -> Column:
    """Whether a text is no JSON. Repeated keys are none of its faults."""
    strict = F.try_parse_json(content)
    lenient = F.from_json(content, "_bad string", _CORRUPT)
    return strict.isNull() & (lenient.isNull() | lenient["_bad"].isNotNull())


def _field(content: Column, name: str, kind: str) -> Column:
    return F.from_json(content, f"`{name}` {kind}", {"allowSingleQuotes": "false"})[name]


def members(content: Column, name: str) -> Column:
    """``array<struct<key, text, is_string>>`` of the object under a top-level key, the last member of a name
    alone; empty where there is no such object.

    A value that is no string is told by its type, or by its text where an object among the values itself
    repeats a key.
    """
    typed = F.map_entries(_field(content, name, "map<string,variant>"))

    def listed(texts: Column) -> Column:
        def known(kinds: Column) -> Column:
            return F.transform(
                texts,
                lambda e, i: F.struct(
                    e["key"].alias("key"),
                    e["value"].alias("text"),
                    F.when(
                        F.size(kinds) == F.size(texts), F.schema_of_variant(F.get(kinds, i)["value"]) == "STRING"
                    ).otherwise(~e["value"].rlike(_NO_STRING)).alias("is_string"),
                ),
            )

        return let(typed, known)

    def last(rows: Column) -> Column:
        keys = F.transform(rows, lambda e: e["key"])
        repeated = F.filter(rows, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), rows).otherwise(repeated)

    found = let(F.map_entries(_field(content, name, "map<string,string>")), listed)
    return F.coalesce(let(found, last), F.array().cast(f"array<{MEMBER}>"))


def string_list(content: Column, *names: str) -> Column:
    """The list of strings under the path of top-level keys ``names``, NULL where there is none."""
    kind = "array<string>"
    for name in reversed(names[1:]):
        kind = f"struct<`{name}`:{kind}>"
    value = _field(content, names[0], kind)
    for name in names[1:]:
        value = value[name]
    return value
