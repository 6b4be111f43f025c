"""Rows that fail to parse (problem 2): loads what is valid and sets the rest aside with the reason and its place.

Method: a recursive-descent grammar over the text.  A syntax error (broken quotes) does not end the
parse: it is reported with its offset, and parsing resumes at the next validated record-start anchor.
For a table of lines every row start is such an anchor; for whole files an anchor is a line start at
which a complete record parses whose first field has the right type.

    text   := record (line-break record)*
    record := field ("," field)*            field := quoted | bare
    quoted := '"' (any but '"' | '""')* '"'  followed by "," or the end of the record
    bare   := (any but '"' and ",")*         blanks around it are ignored
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

BLANKS = " \t"
_QUOTED = re.compile(r'"((?:[^"]|"")*)"')
_BARE = re.compile(r'[^",]*')
_BARE_LINE = re.compile(r'[^",\n]*')
_WHOLE = re.compile(r"[+-]?[0-9]+")
_DECIMAL = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")


def _whole(bits: int):
    top = 1 << (bits - 1)

    def read(s: str):
        # more digits than any value of the type has are not converted
        if not _WHOLE.fullmatch(s) or len(s.lstrip("+-").lstrip("0")) > 20:
            return None
        v = int(s)
        return v if -top <= v < top else None

    return read


def _positive(s: str):
    if not _DECIMAL.fullmatch(s):
        return None
    v = float(s)
    return v if 0 < v < math.inf else None


def _text(s: str):
    return s if s.strip() else None


READERS = {"int64": (_whole(64), T.LongType(), pa.int64()), "int32": (_whole(32), T.IntegerType(), pa.int32()), "text": (_text, T.StringType(), pa.string()), "positive": (_positive, T.DoubleType(), pa.float64())}
#: Columns of a header-less metadata file.
METADATA = (("index", "int64"), ("label", "text"), ("modcod", "int32"), ("sample_rate", "positive"))


class Broken(Exception):
    def __init__(self, offset: int, field_no: int, what: str):
        self.offset, self.field_no, self.what = offset, field_no, what


@dataclass
class Record:
    """A parsed record: values when it is valid, else reason, field number (from 1) and offset in the text."""

    start: int
    values: list | None = None
    reason: str | None = None
    field_no: int | None = None
    offset: int | None = None
    detail: str | None = None
    fields: list = field(default_factory=list)


class Grammar:
    def __init__(self, columns=METADATA):
        self.columns = columns
        self.readers = [READERS[k][0] for _, k in columns]

    def record(self, s: str, at: int, end: int, lines: bool) -> tuple[list[tuple[str, int]], int]:
        """Fields with their offsets, and the position after the record; raises Broken."""
        out = []
        while True:
            value, nxt = self._field(s, at, end, len(out) + 1, lines)
            out.append((value, at))
            if nxt < end and s[nxt] == ",":
                at = nxt + 1
                continue
            return out, nxt

    def _field(self, s: str, at: int, end: int, no: int, lines: bool) -> tuple[str, int]:
        if at < end and s[at] == '"':
            return self._quoted(s, at, end, no, lines)
        m = (_BARE_LINE if lines else _BARE).match(s, at, end)
        stop = m.end()
        if stop < end and s[stop] == '"':
            raise Broken(stop, no, "a quote inside a field that is not wrapped")
        value = m.group()
        if (stop == end or s[stop] != ",") and value.endswith("\r"):
            value = value[:-1]
        return value.strip(BLANKS), stop

    def _quoted(self, s: str, at: int, end: int, no: int, lines: bool) -> tuple[str, int]:
        m = _QUOTED.match(s, at, end)
        if not m:
            raise Broken(at, no, "a quote that is never closed")
        stop = m.end()
        if stop < end and s[stop] == "\r" and (stop + 1 == end or (lines and s[stop + 1] == "\n")):
            stop += 1
        if stop < end and s[stop] != "," and not (lines and s[stop] == "\n"):
            raise Broken(stop, no, "text after a closing quote")
        return m.group(1).replace('""', '"'), stop

    def typed(self, start: int, fields: list[tuple[str, int]]) -> Record:
        """Column count first, then the types."""
        if len(fields) != len(self.columns):
            return Record(start, None, "column_count", None, start, f"{len(fields)} fields")
        values = []
        for no, ((text, at), read) in enumerate(zip(fields, self.readers), 1):
            v = read(text)
            if v is None:
                return Record(start, None, "invalid_value", no, at, f"{self.columns[no - 1][0]}: {text[:80]!r}")
            values.append(v)
        return Record(start, values)

    def rows(self, texts: list[str | None]) -> Iterator[Record]:
        """One record for each row: the rows are parsed as one text in which every row start is an anchor."""
        whole = "".join(t or "" for t in texts)
        at = 0
        for t in texts:
            start, end = at, at + len(t or "")
            r, at = self.step(whole, start, end, False, lambda end=end: end)
            if r.offset is not None:
                r.offset -= start
            yield r

    def file(self, s: str) -> Iterator[Record]:
        """All records of a file; after broken quotes it resumes at the next validated anchor."""
        at, end = 0, len(s)
        while at < end:
            r, at = self.step(s, at, end, True, lambda at=at: self._anchor(s, at, end))
            yield r

    def step(self, s: str, at: int, end: int, lines: bool, anchor) -> tuple[Record, int]:
        """The record at ``at`` and where the next one starts; after broken quotes that is ``anchor()``, a record start known to be one."""
        try:
            fields, nxt = self.record(s, at, end, lines)
            if lines and nxt < end and s[nxt] != "\n":
                raise Broken(nxt, len(fields), "text after a closing quote")
            return self.typed(at, fields), nxt + lines
        except Broken as x:
            return Record(at, None, "broken_quoting", x.field_no, x.offset, x.what), anchor()

    def _anchor(self, s: str, at: int, end: int) -> int:
        line = s.find("\n", at)
        while line >= 0:
            if self._starts(s, line + 1, end):
                return line + 1
            line = s.find("\n", line + 1)
        return end

    def _starts(self, s: str, at: int, end: int) -> bool:
        try:
            fields, _ = self.record(s, at, end, True)
        except Broken:
            return False
        return len(fields) == len(self.columns) and self.readers[0](fields[0][0]) is not None


def parse_lines(df: DataFrame, text: str = "raw_line", columns=METADATA) -> DataFrame:
    """Every row of df with two columns added: ``record`` (typed, null if invalid) and ``error`` (null if valid).

    error has reason (broken_quoting, column_count, invalid_value), field_no, offset in the line and detail.
    A null or empty line is one empty field, hence column_count.  Columns of df called record or error
    are replaced.  Map-only; rows are independent, so any file size and skew spreads over all tasks.
    """
    keep = [c for c in df.columns if c not in ("record", "error")]
    at = df.columns.index(text)
    record = T.StructType([T.StructField(n, READERS[k][1]) for n, k in columns])
    error = T.StructType([T.StructField("reason", T.StringType()), T.StructField("field_no", T.IntegerType()), T.StructField("offset", T.IntegerType()), T.StructField("detail", T.StringType())])
    schema = T.StructType([f for f in df.schema.fields if f.name in keep] + [T.StructField("record", record), T.StructField("error", error)])
    names, kinds = [n for n, _ in columns], [READERS[k][2] for _, k in columns]
    record_t = pa.struct(list(zip(names, kinds)))
    error_t = pa.struct([("reason", pa.string()), ("field_no", pa.int32()), ("offset", pa.int32()), ("detail", pa.string())])

    def run(batches):
        g = Grammar(columns)
        for b in batches:
            got = list(g.rows(b.column(at).to_pylist()))
            rec = pa.array([None if r.values is None else dict(zip(names, r.values)) for r in got], record_t)
            err = pa.array([None if r.reason is None else {"reason": r.reason, "field_no": r.field_no, "offset": r.offset, "detail": r.detail} for r in got], error_t)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(c)) for c in keep), rec, err], names=[*keep, "record", "error"])

    return df.mapInArrow(run, schema)


def parse_files(df: DataFrame, content: str = "content", columns=METADATA) -> DataFrame:
    """Records of whole files (one text a row): the other columns of df, start offset, record, error.

    A file is one task's work; large inputs come as many files.  Null or empty files give no row.
    """
    keep = [c for c in df.columns if c not in (content, "start", "record", "error")]
    at = df.columns.index(content)
    one = parse_lines(df.select(content), content, columns).schema
    schema = T.StructType([f for f in df.schema.fields if f.name in keep] + [T.StructField("start", T.LongType()), one["record"], one["error"]])
    names, kinds = [n for n, _ in columns], [READERS[k][2] for _, k in columns]
    record_t = pa.struct(list(zip(names, kinds)))
    error_t = pa.struct([("reason", pa.string()), ("field_no", pa.int32()), ("offset", pa.int32()), ("detail", pa.string())])

    def run(batches):
        g = Grammar(columns)
        for b in batches:
            row, got = [], []
            for k, text in enumerate(b.column(at).to_pylist()):
                for r in g.file(text or ""):
                    row.append(k)
                    got.append(r)
            rec = pa.array([None if r.values is None else dict(zip(names, r.values)) for r in got], record_t)
            err = pa.array([None if r.reason is None else {"reason": r.reason, "field_no": r.field_no, "offset": r.offset, "detail": r.detail} for r in got], error_t)
            pick = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(c)).take(pick) for c in keep), pa.array([r.start for r in got], pa.int64()), rec, err], names=[*keep, "start", "record", "error"])

    return df.mapInArrow(run, schema)


def load(df: DataFrame, text: str = "raw_line", columns=METADATA) -> tuple[DataFrame, DataFrame]:
    """(valid rows with their typed columns, rejected rows with reason, field_no, offset and detail)."""
    both = parse_lines(df, text, columns)
    keep = [F.col(c) for c in df.columns if c not in ("record", "error", text, *(n for n, _ in columns))]
    return both.where("record is not null").select(*keep, "record.*"), both.where("error is not null").select(*[F.col(c) for c in df.columns if c not in ("record", "error", "reason", "field_no", "offset", "detail")], "error.*")
