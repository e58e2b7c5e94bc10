"""Aligners as external programs: each map task pipes its reads through one process.

The program reads FASTQ on its standard input and writes SAM on its standard output,
for example ``["bowtie2", "-x", index, "-U", "-"]``.  It has to be installed on every
worker; building an index is left to the program itself.
"""

from __future__ import annotations

import subprocess
import threading

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.sources.text import parse_sam


def run_tool(command: list[str]) -> str:
    """Run a program on the driver, say an index builder; its output, or an error with what it said."""
    done = subprocess.run(command, capture_output=True, text=True, check=False)
    if done.returncode:
        raise RuntimeError(f"{command[0]} ended with {done.returncode}: {done.stderr[-2000:]}")
    return done.stdout


def sam_lines(df: DataFrame, command: list[str]) -> DataFrame:
    """(value): the SAM lines that the program writes for (header, seq, qual)."""

    def run(batches):
        with subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as process:
            said: list[bytes] = []

            def feed():
                try:
                    for batch in batches:
                        for header, seq, qual in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                            process.stdin.write(f"@{header}\n{seq}\n+\n{qual}\n".encode())
                    process.stdin.close()
                except BrokenPipeError:
                    pass

            threads = [threading.Thread(target=feed, daemon=True), threading.Thread(target=lambda: said.append(process.stderr.read()), daemon=True)]
            for t in threads:
                t.start()
            lines: list[str] = []
            for line in process.stdout:
                if not line.startswith(b"@"):
                    lines.append(line.decode().rstrip("\n"))
                if len(lines) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
                    lines = []
            for t in threads:
                t.join()
            if process.wait():
                raise RuntimeError(f"{command[0]} ended with {process.returncode}: {b''.join(said)[-2000:].decode(errors='replace')}")
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    return df.select("header", "seq", "qual").mapInArrow(run, "value string").where(F.length("value") > 0)


def align(df: DataFrame, command: list[str], **options) -> DataFrame:
    """SAM records of the reads."""
    return parse_sam(sam_lines(df, command), **options)
