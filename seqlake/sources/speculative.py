"""FASTA and FASTQ of any form in splits: records are found from the middle of a file by speculation.

Where a split of a FASTQ file begins it is not known whether a line belongs to a header, a sequence or a quality: each may
hold any sign. A first pass therefore follows every guess at once: each line with '@' may begin a record, and from there
on all is determined. A guess that fails is dropped, and guesses that come to the same state are one from then on, so few
are ever alive. What a pass tells of a split is short: by which guess it ends in which state, and how many letters it
takes to finish a sequence or quality that came from before. The second step goes through the splits of each file in order
and fixes, from the state in which one ends, the guess that holds in the next one. The third reads every split from its
true state, and reads on behind its end until its last record is whole. Nothing but those short rows is shuffled.

States: (HEAD, 0): a record's header must follow; (SEQ, n): in a sequence of which n letters have been read;
(QUAL, n): n letters of a quality are to come. FASTA needs no guesses: a line with '>' begins a record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from .blocks import layout, lines
from .fastx import _finished, head_desc, head_id
from .ranges import Reader, dealt, open_file

HEAD, SEQ, QUAL = 0, 1, 2
State = tuple[int, int]
#: Letters of sequences in a batch of records.
BATCH = 1 << 24
#: Bytes of ranges that a task works on, one after the other, where there are many.
WORK = 1 << 24


def step(state: State, line: bytes) -> State | None:
    """The state behind a line; None if a line of this kind can't stand here."""
    kind, n = state
    if kind == QUAL:
        left = n - len(line)
        return None if left < 0 else (QUAL, left) if left else (HEAD, 0)
    if kind == SEQ:
        return ((QUAL, n) if n else (HEAD, 0)) if line.startswith(b"+") else (SEQ, n + len(line))
    return state if not line else (SEQ, 0) if line.startswith(b"@") else None


def summary(rows: Iterator[bytes]) -> dict:
    """What must be known of a split to tell from its first state the last one.

    letters: of all its lines. plus: letters before its first line with '+', and behind it; -1: there is none. ends: last states
    of the guesses that hold, each with the letters before the lines where it may have begun; of the one with the most
    places these are not kept (null): what is in no other list belongs to it.
    """
    letters, plus, behind = 0, -1, 0
    alive: dict[State, list[int]] = {}
    for raw in rows:
        line = raw.rstrip(b"\r")
        now: dict[State, list[int]] = {}
        for state, places in alive.items():
            after = step(state, line)
            if after is None:
                continue
            other = now.get(after)
            if other is None:
                now[after] = places
            else:
                large, small = (other, places) if len(other) >= len(places) else (places, other)
                large.extend(small)
                now[after] = large
        if line.startswith(b"@"):
            now.setdefault((SEQ, 0), []).append(letters)
        if plus < 0 and line.startswith(b"+"):
            plus, behind = letters, letters + len(line)
        alive = now
        letters += len(line)
    most = max(alive, key=lambda s: len(alive[s]), default=None)
    return {"letters": letters, "plus": plus, "behind": behind, "ends": [{"kind": s[0], "n": s[1], "places": None if s == most else sorted(places)} for s, places in alive.items()]}


def follow(state: State, told: dict) -> State:
    """The last state of a split by its first one."""
    kind, n = state
    if kind == SEQ:
        if told["plus"] < 0:
            return SEQ, n + told["letters"]
        begin = told["behind"] + n + told["plus"]
    else:
        begin = n
    if begin > told["letters"]:
        return QUAL, begin - told["letters"]
    if begin == told["letters"]:
        return HEAD, 0
    ends = told["ends"]
    found = next((e for e in ends if e["places"] is not None and begin in e["places"]), next((e for e in ends if e["places"] is None), None))
    if found is None:
        raise ValueError("a quality is longer or shorter than its sequence, or a record does not begin with '@'")
    return found["kind"], found["n"]


_RANGE = ["path", "kind", "length", "start", "end"]
_KINDS = "path string, kind string, length long, start long, end long"
_TOLD = f"{_KINDS}, sign string, letters long, plus long, behind long, ends array<struct<kind:int,n:long,places:array<long>>>"
_STATES = f"{_KINDS}, sign string, state int, n long"
_RECORDS = "path string, block long, nr long, name string, seq string, qual string"


def summaries(parts: DataFrame) -> DataFrame:
    """What summary() tells of each range (path, kind, length, start, end), and sign: how its first line that is not blank begins."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                with open_file(r.path) as f:
                    rows, first = lines(Reader(f), r.path, r.kind, r.start, r.end), []
                    for row in rows:
                        first.append(row)
                        if row.rstrip(b"\r"):
                            break
                    sign = first[-1][:1].decode("latin-1").strip("\r") if first else ""
                    # A file's front tells that it holds FASTA; of later ranges that is not known yet.
                    out.append((*r, sign, *summary(iter(()) if sign == ">" and not r.start else chain(first, rows)).values()))
            yield pd.DataFrame(out, columns=[*_RANGE, "sign", "letters", "plus", "behind", "ends"])

    return dealt(parts, WORK).mapInPandas(told, _TOLD)


def states(told: DataFrame) -> DataFrame:
    """The first state of each range, and its file's sign. A file's ranges, a short row each, are gone through in order."""

    def through(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        sign = next((s for s in pdf.sign if s), "")
        if sign not in (">", "@", ""):
            raise ValueError("neither FASTA nor FASTQ")
        state, out = (HEAD, 0), []
        for r in pdf.itertuples(index=False):
            out.append((*r[:5], sign, *state))
            if sign == "@":
                ends = [{"kind": e["kind"], "n": e["n"], "places": None if e["places"] is None else [int(x) for x in e["places"]]} for e in r.ends]
                state = follow(state, {"letters": r.letters, "plus": r.plus, "behind": r.behind, "ends": ends})
        if state[0] == QUAL:
            raise ValueError("the last record's sequence and quality differ in length")
        return pd.DataFrame(out, columns=[*_RANGE, "sign", "state", "n"])

    return told.groupBy("path").applyInPandas(through, _STATES)


def fasta_in(own: Iterator[bytes], more: Iterator[bytes], wanted: Callable[[str], bool] = lambda name: True) -> Iterator[tuple[str, str, None]]:
    """(name, seq, None) of the records whose headers are own lines; more: the lines behind them. Of records that are not wanted by
    their names nothing else is read."""
    name, seq = None, []
    for line, mine in chain(((x, True) for x in own), ((x, False) for x in more)):
        if line.startswith(b">"):
            if name is not None:
                yield name, "".join(seq), None
            name, seq = None, []
            if not mine:
                return
            name = line.rstrip(b"\r")[1:].decode("latin-1")
            name = name if wanted(name) else None
        elif name is not None:
            seq.append(line.rstrip(b"\r").decode("latin-1"))
        elif not mine:
            return
    if name is not None:
        yield name, "".join(seq), None


def fastq_in(own: Iterator[bytes], more: Iterator[bytes], state: State, wanted: Callable[[str], bool] = lambda name: True) -> Iterator[tuple[str, str, str]]:
    """(name, seq, qual) of the wanted records whose headers are own lines, by the state before the first one."""
    name, seq, qual, taken = None, [], [], True
    for raw, mine in chain(((x, True) for x in own), ((x, False) for x in more)):
        if not mine and (name is None or state[0] == HEAD):
            break  # nothing of this range is open
        line = raw.rstrip(b"\r")
        after = step(state, line)
        if after is None:
            raise ValueError(f"sequence and quality of {name!r} differ in length")
        if state[0] == HEAD and line:
            if name is not None and taken:
                yield name, "".join(seq), "".join(qual)
            name, seq, qual = line[1:].decode("latin-1"), [], []
            taken = wanted(name)
        elif taken and state[0] == QUAL:
            qual.append(line.decode("latin-1"))
        elif taken and state[0] == SEQ and after[0] == SEQ:
            seq.append(line.decode("latin-1"))
        state = after
    if name is not None and taken:
        yield name, "".join(seq), "".join(qual)


def read_split(spark: SparkSession, path: str | list[str], id_regexp: str | None = None, alphabet: str | None = None, validate: bool = False, size: int | None = None) -> DataFrame:
    """As read_fastx, of FASTA or FASTQ files of any form, wrapped or not, but plain and blocked-gzip files are split among tasks in
    ranges of size bytes; other compressed files are one task's work each. In place of rec_no: block and nr, the order of records in
    a file. Files without a record give no rows; a range may be smaller than a line or hold no record's begin.
    """
    known = states(summaries(layout(spark, path, size)))
    kept = shared_path(spark, "splits")
    known.write.parquet(kept)  # two more passes would follow if it were lost
    known = spark.read.schema(known.schema).parquet(kept)
    names = [x.split()[0] for x in _RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(names), kinds, strict=True)], names=names)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, kind, length, start, end, sign, state, n in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                out, held = [], 0
                with open_file(path_) as f:
                    own, more = lines(Reader(f), path_, kind, start, end), lines(Reader(f), path_, kind, end, length) if end < length else iter(())
                    for nr, record in enumerate(fasta_in(own, more) if sign == ">" else fastq_in(own, more, (state, n))):
                        out.append((path_, start, nr, *record))
                        held += len(record[1])
                        if held > BATCH or len(out) >= 10_000:
                            yield batch_of(out)
                            out, held = [], 0
                yield batch_of(out)

    rows = dealt(known, WORK).mapInArrow(parsed, _RECORDS)
    rows = rows.select("path", "block", "nr", head_id(F.col("name"), id_regexp).alias("id"), "name", head_desc(F.col("name"), id_regexp).alias("desc"), "seq", "qual")
    return _finished(rows, alphabet, validate, F.col("qual").isNotNull())
