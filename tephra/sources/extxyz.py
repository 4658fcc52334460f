"""Labelled structures in extended-XYZ text: a scan that splits large files, label lookup, a writer.

A frame is a line with the number of atoms, a header of key=value pairs with Lattice and Properties, and a line per atom.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, offset long, n int, species array<string>, positions array<array<double>>, cell array<array<double>>, pbc array<boolean>, info map<string,string>, arrays map<string,array<array<double>>>"
PAIR = re.compile(r"""([^\s=]+)=("(?:[^"\\]|\\.)*"|\{[^}]*\}|\S+)|(\S+)""")
#: Chemical symbols by atomic number (fixed values).
SYMBOLS = (
    "X H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()


def header(line: str) -> dict[str, str]:
    """key=value pairs of a frame's second line; a bare word is true. Escaped quotes are undone; a ``_JSON`` value is checked and kept as JSON text."""
    out = {}
    for m in PAIR.finditer(line):
        raw = m[2] or "T"
        text = raw[1:-1].replace('\\"', '"').replace("\\\\", "\\") if len(raw) > 1 and raw[0] == raw[-1] == '"' else raw
        if text.startswith("_JSON"):
            text = json.dumps(json.loads(text[5:]), separators=(",", ":"))
        elif raw[0] == "{":
            text = raw.strip("{}")
        out[m[1] or m[3]] = text
    return out


def frame(lines: Sequence[str], where: str) -> dict:
    """One frame from its lines; a malformed frame is an error that names its place."""
    info = header(lines[1])
    kinds = info.pop("Properties", "species:S:1:pos:R:3").split(":")
    columns = [(kinds[i], kinds[i + 1], int(kinds[i + 2])) for i in range(0, len(kinds), 3)]
    rows = [line.split() for line in lines[2:]]
    if any(len(r) != sum(c[2] for c in columns) for r in rows):
        raise ValueError(f"{where}: an atom's line does not have the columns of Properties")
    if not {"species", "Z"} & {c[0] for c in columns} or "pos" not in {c[0] for c in columns}:
        raise ValueError(f"{where}: Properties lack species or positions")
    out: dict = {"n": len(rows), "species": [], "positions": [], "arrays": {}}
    at = 0
    for name, kind, width in columns:
        part = [r[at : at + width] for r in rows]
        at += width
        if name in ("species", "Z"):
            out["species"] = [p[0] if kind == "S" else SYMBOLS[int(p[0])] for p in part]
            if unknown := set(out["species"]) - set(SYMBOLS):
                raise ValueError(f"{where}: unknown species {sorted(unknown)}")
        elif name == "pos":
            out["positions"] = [[float(v) for v in p] for p in part]
        elif kind in "RIL":
            out["arrays"][name] = [[1.0 if v in ("T", "True") else 0.0 if v in ("F", "False") else float(v) for v in p] for p in part]
    lattice = info.pop("Lattice", None)
    out["cell"] = np.array(lattice.split(), float).reshape(3, 3).tolist() if lattice else None
    pbc = info.pop("pbc", "T T T" if lattice else "F F F").split()
    out["pbc"] = [p in ("T", "True", "1") for p in pbc] if lattice else [False] * 3
    out["info"] = info
    return out


def _frames(read, size: int, start: int, end: int, name: str) -> Iterator[tuple]:
    """Frames whose first line begins in [start, end) of a file.

    Only before a range's first frame are lines passed over, as they belong to the range before; after a frame, or at
    the file's beginning, a line that is neither blank nor a number of atoms is an error.
    """
    strict = start == 0
    read.seek(start)
    if start:
        read.seek(start - 1)
        read.readline()  # to the next line's beginning
    while read.tell() < end:
        offset = read.tell()
        first = read.readline()
        if not first.strip():
            continue
        if not first.strip().isdigit():
            if strict:
                raise ValueError(f"{name} at byte {offset}: {first[:60]!r} is not a number of atoms")
            continue
        after = read.tell()
        second = read.readline().decode()
        if not strict and "=" not in second:
            read.seek(after)
            continue
        strict = True
        lines = [first.decode(), second, *(read.readline().decode() for _ in range(int(first)))]
        f = frame([x.rstrip("\n") for x in lines], f"{name} at byte {offset}")
        yield name, offset, f["n"], f["species"], f["positions"], f["cell"], f["pbc"], f["info"], f["arrays"]
    after = read.tell()
    if strict and end <= after < size and (line := read.readline().strip()) and not line.isdigit():
        raise ValueError(f"{name} at byte {after}: {line[:60]!r} is not a number of atoms")


def read_extxyz(spark: SparkSession, paths: Sequence[str], split: int = 64 << 20) -> DataFrame:
    """Frames of files, scanned in ranges of ``split`` bytes; a frame belongs to the range in which it begins."""
    from pyarrow import fs

    def opened(uri: str):
        system, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
        return system, path

    ranges = []
    for uri in paths:
        system, path = opened(uri)
        size = system.get_file_info(path).size
        ranges += [(uri, size, a, min(a + split, size)) for a in range(0, size, split)]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                system, path = opened(r.uri)
                with system.open_input_file(path) as f:
                    import io

                    found = list(_frames(io.BufferedReader(f), r.size, r.start, r.end, r.uri))
                if found:
                    yield pd.DataFrame(found, columns=[x.split()[0] for x in re.split(r", (?=\w+ )", SCHEMA)])

    table = spark.createDataFrame(ranges, "uri string, size long, start long, `end` long") if ranges else spark.createDataFrame([], "uri string, size long, start long, `end` long")
    return table.repartition(max(1, len(ranges))).mapInPandas(scan, SCHEMA)


def label(values: Column, key: str) -> Column:
    """A map's value by key: exact, else with case ignored."""
    loose = F.map_values(F.map_filter(values, lambda k, v: F.lower(k) == key.lower()))
    return F.coalesce(F.try_element_at(values, F.lit(key)), F.try_element_at(loose, F.lit(1)))


def stress_to_virial(stress: Column, cell: Column) -> Column:
    """-stress * volume as nine numbers; stress as nine numbers or in Voigt order xx yy zz yz xz xy."""
    a = [[cell[i][j] for j in range(3)] for i in range(3)]
    volume = F.abs(a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0]))
    full = F.when(F.size(stress) == 6, F.array(*[F.get(stress, i) for i in (0, 5, 4, 5, 1, 3, 4, 3, 2)])).otherwise(stress)
    return F.transform(full, lambda s: -s * volume)


def configs(frames: DataFrame, *, energy: str = "energy", forces: str = "forces", virial: str = "virial", stress: str | None = None) -> DataFrame:
    """Typed configurations: nullable energy, forces, virial (nine numbers) and type. A label that is there but unreadable is an error; a missing one is null."""
    numbers = lambda c: F.transform(F.split(F.trim(c), r"\s+"), lambda x: x.cast("double"))  # noqa: E731  casts raise under ANSI
    out = frames.withColumn("energy", label(F.col("info"), energy).cast("double")).withColumn("forces", label(F.col("arrays"), forces)).withColumn("virial", numbers(label(F.col("info"), virial)))
    if stress:
        derived = F.when(F.exists("pbc", lambda p: p), stress_to_virial(numbers(label(F.col("info"), stress)), F.col("cell")))
        out = out.withColumn("virial", F.coalesce("virial", derived))
    wrong = F.col("virial").isNotNull() & (F.size("virial") != 9)
    return out.withColumn("virial", F.when(wrong, F.raise_error(F.concat(F.lit("virial of the wrong size in "), F.col("file")))).otherwise(F.col("virial"))).withColumn("config_type", label(F.col("info"), "config_type"))


def atoms(frames: DataFrame) -> DataFrame:
    """(file, offset, atom, species, x, y, z): a row per atom."""
    each = frames.select("file", "offset", F.posexplode(F.arrays_zip("species", "positions")).alias("atom", "a"))
    return each.select("file", "offset", "atom", F.col("a.species").alias("species"), *[F.col("a.positions")[i].alias(c) for i, c in enumerate("xyz")])


def format_frame(species: Sequence[str], positions: Sequence[Sequence[float]], cell, info: dict[str, object]) -> str:
    """One frame as text."""
    parts = [f'Lattice="{" ".join(repr(float(v)) for r in cell for v in r)}"'] if cell is not None else []
    parts.append("Properties=species:S:1:pos:R:3")
    parts += [f"{k}={json.dumps(str(v)) if ' ' in str(v) else v}" for k, v in info.items()]
    rows = [f"{s} {' '.join(repr(float(v)) for v in p)}" for s, p in zip(species, positions, strict=True)]
    return "\n".join([str(len(rows)), " ".join(parts), *rows]) + "\n"


def write_extxyz(frames: DataFrame, path: str) -> None:
    """Frames as text files, one per partition."""

    def text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"value": [format_frame(r.species, r.positions, r.cell, dict(r.info or {})).rstrip("\n") for r in batch.itertuples()]})

    frames.select("species", "positions", "cell", "info").mapInPandas(text, "value string").write.text(path)
