"""Wire formats of keys and values, as column expressions both ways."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Serde:
    """``decode`` turns wire bytes or text into the type, failing the query on bad input."""

    data_type: T.DataType

    def parse(self, wire: Column) -> Column:
        """The dear part of ``decode``, to be projected before ``checked`` reads it."""
        return wire

    def checked(self, parsed: Column) -> Column:
        raise NotImplementedError

    def decode(self, wire: Column) -> Column:
        """Both in one expression."""
        return self.checked(self.parse(wire))

    def encode(self, value: Column) -> Column:
        raise NotImplementedError


@dataclass
class String(Serde):
    """UTF-8 text; bytes that are not UTF-8 fail."""

    data_type: T.DataType = field(default_factory=T.StringType)

    def checked(self, parsed: Column) -> Column:
        return F.validate_utf8(parsed.cast("string"))

    def encode(self, value: Column) -> Column:
        return value.cast("string")


@dataclass
class Int64Text(Serde):
    """A 64-bit number as decimal text; other text fails."""

    data_type: T.DataType = field(default_factory=T.LongType)

    def checked(self, parsed: Column) -> Column:
        text = parsed.cast("string")
        number = text.try_cast("long") if hasattr(text, "try_cast") else text.cast("long")
        ok = text.rlike(r"^[+-]?[0-9]+$") & number.isNotNull()
        return F.when(ok, number).when(text.isNotNull(), F.raise_error(F.concat(F.lit("not a 64-bit number: "), text)).cast("long"))

    def encode(self, value: Column) -> Column:
        return value.cast("string")


@dataclass
class Json(Serde):
    """JSON objects of a declared schema.

    ``aliases`` maps a field to other spellings that are accepted on reading;
    writing uses the field's own name.  Unknown fields are ignored; malformed
    text and absent fields fail unless ``lenient``.
    """

    data_type: T.StructType
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    lenient: bool = False

    def _wide(self) -> T.StructType:
        """The fields under all their spellings."""
        return T.StructType([T.StructField(n, f.dataType) for f in self.data_type for n in (f.name, *self.aliases.get(f.name, ()))])

    def parse(self, wire: Column) -> Column:
        mode = {"mode": "PERMISSIVE" if self.lenient else "FAILFAST"}
        text, wide = wire.cast("string"), self._wide()
        if len({n.lower() for n in wide.names}) == len(wide.names):
            return F.from_json(text, wide, mode)
        # spellings that differ in case only cannot stand in one struct of Spark
        return F.struct(*(F.from_json(text, T.StructType([T.StructField(f.name, f.dataType)]), mode)[f.name].alias(f"s{i}") for i, f in enumerate(wide)))

    def checked(self, parsed: Column) -> Column:
        wide = self._wide()
        spread = len({n.lower() for n in wide.names}) != len(wide.names)
        at, parts = 0, []
        for f in self.data_type:
            names = (f.name, *self.aliases.get(f.name, ()))
            value = F.coalesce(*(parsed[f"s{at + i}" if spread else n] for i, n in enumerate(names)))
            at += len(names)
            if not self.lenient:
                value = F.when(value.isNull(), F.raise_error(F.lit(f"missing field {f.name}")).cast(f.dataType)).otherwise(value)
            parts.append(value.alias(f.name))
        return F.when(parsed.isNotNull(), F.struct(*parts))

    def encode(self, value: Column) -> Column:
        return F.to_json(value)


@dataclass
class NativeBytes(Serde):
    """Any Spark type as bytes of Spark's own choice, for changelogs and state; not for other readers."""

    data_type: T.DataType

    def _schema(self) -> T.StructType:
        return T.StructType([T.StructField("v", self.data_type)])

    def parse(self, wire: Column) -> Column:
        return F.from_json(wire.cast("string"), self._schema(), {"mode": "FAILFAST"})

    def checked(self, parsed: Column) -> Column:
        return parsed["v"]

    def encode(self, value: Column) -> Column:
        return F.to_json(F.struct(value.alias("v"))).cast("binary")


@dataclass
class Proto(Serde):
    """Protocol-buffer messages by way of their JSON form; needs the protobuf package on the workers."""

    message: type
    json: Json

    def __post_init__(self):
        self.data_type = self.json.data_type

    def parse(self, wire: Column) -> Column:
        message = self.message

        @F.pandas_udf("string")
        def text(raw: pd.Series) -> pd.Series:
            from google.protobuf import json_format

            return raw.map(lambda x: json_format.MessageToJson(message.FromString(bytes(x)), preserving_proto_field_name=True, indent=None), na_action="ignore")

        return self.json.parse(text(wire))

    def checked(self, parsed: Column) -> Column:
        return self.json.checked(parsed)

    def encode(self, value: Column) -> Column:
        message = self.message

        @F.pandas_udf("binary")
        def raw(text: pd.Series) -> pd.Series:
            from google.protobuf import json_format

            return text.map(lambda x: json_format.Parse(x, message()).SerializeToString(), na_action="ignore")

        return raw(self.json.encode(value))


def json_tuple(*values: Column) -> Column:
    """A JSON array of values of different types, each a struct or a string, number or boolean text."""
    return F.concat(F.lit("["), F.concat_ws(",", *values), F.lit("]"))
