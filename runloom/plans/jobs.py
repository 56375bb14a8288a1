"""Run SQL texts, SQL files and Python functions as jobs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# What a semicolon may sit in without ending a statement: quotes, comments, and blocks of words.
_PIECES = re.compile(
    r"""'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|`[^`]*`|--[^\n]*|/\*|\*/|;|\w+|[^'"`;/*\-\w]+|.""", re.S)
# Words that open and close what END ends; a script block begins a statement with BEGIN.
_OPENS = ("BEGIN", "CASE", "IF", "LOOP", "WHILE", "REPEAT", "FOR")


def split_statements(text: str) -> list[str]:
    """The statements of a SQL text, in order, without comments between them and empty ones.

    Comments may nest; hints stay. A ``BEGIN ... END`` block, which begins its statement, stays whole.
    """
    statements, current, comment, depth = [], "", 0, 0
    pieces = _PIECES.findall(text)
    before = ""
    for i, piece in enumerate(pieces):
        if comment:
            comment += (piece == "/*") - (piece == "*/")
            continue
        hint = piece == "/*" and i + 1 < len(pieces) and pieces[i + 1].startswith("+")
        if piece == "/*" and not hint:
            comment, current = 1, current + " "
            continue
        if piece.startswith("--"):
            current += " "
            continue
        word = piece.upper()
        if not depth and word == "BEGIN" and not current.strip():
            depth = 1
        elif depth and word in _OPENS and before != "END" and (word in ("BEGIN", "CASE") or before in (
                "", ";", "BEGIN", "THEN", "ELSE", "DO", "LOOP", ":")):
            depth += 1
        elif depth and word == "END":
            depth -= 1
        if piece == ";" and not depth:
            statements.append(current)
            current = ""
        else:
            current += piece
        if piece.strip():
            before = word
    statements.append(current)
    return [s.strip() for s in statements if s.strip()]


def run_statements(spark: SparkSession, statements: str | Iterable[str] | None,
                   params: Mapping[str, Any] | None = None) -> DataFrame:
    """Run statements one after the other in one session; return the last one's result.

    Queries before the last run too, over all their rows, though nobody sees what they return. The
    first failure stops the job. ``params`` fill named markers such as ``:since``.
    """
    if statements is None:
        raise ValueError("a SQL job needs sql")
    if isinstance(statements, str):
        statements = split_statements(statements)
    result = None
    for statement in statements:
        if result is not None and result.columns:
            # A command has run already and holds its few rows; a query has only been planned.
            result.write.format("noop").mode("overwrite").save()
        used = {k: v for k, v in (params or {}).items() if re.search(rf":{k}\b", statement)}
        result = spark.sql(statement, args=used) if used else spark.sql(statement)
    if result is None:
        raise ValueError("a SQL job needs at least one statement")
    return result


def run_script(spark: SparkSession, script: str,
               params: Mapping[str, Any] | None = None) -> DataFrame:
    """Run one ``BEGIN ... END`` script as Spark's own scripting does; return its last result."""
    return spark.sql(script, args=dict(params)) if params else spark.sql(script)


def run_sql_file(spark: SparkSession, path: str | None,
                 params: Mapping[str, Any] | None = None) -> DataFrame:
    """The same for a SQL file on any file system that Spark can read."""
    if not path:
        raise ValueError("a SQL file job needs sqlFile")
    text = spark.read.text(path, wholetext=True).first()[0]
    return run_statements(spark, text, params)


def run_job(spark: SparkSession, job: Callable[[SparkSession, Mapping[str, Any]], DataFrame] | None,
            params: Mapping[str, Any] | None = None, py_files: Iterable[str] = ()) -> DataFrame:
    """Run a Python job; ``py_files`` are made importable on the executors first."""
    if job is None:
        raise ValueError("a Python job needs a function")
    for path in py_files:
        spark.sparkContext.addPyFile(path)
    return job(spark, dict(params or {}))
