"""CIF files as a table: categories to rows of named values, and the scans of atoms and sequences that read it."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The standard residues by three letters, selenomethionine with them.
RESIDUES = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
    "MSE": "M",
}

#: Text between semicolons at line starts; values in quotes, which close only before white space; comments; plain values.
TOKEN = re.compile(
    r"""^;(?P<text>(?:[^\n]*\n(?!;))*[^\n]*)\n;(?=\s|\Z)
      | '(?P<single>(?:[^'\n]|'(?!\s|\Z))*)'(?=\s|\Z)
      | "(?P<double>(?:[^"\n]|"(?!\s|\Z))*)"(?=\s|\Z)
      | \#[^\n]*
      | (?P<plain>\S+)""",
    re.M | re.X,
)


LONG, ROWS = 1 << 18, 5000  # characters of a text whose rows are not held until its end; rows handed on at once


class CifError(ValueError):
    """The text is no CIF: a value is not closed, or a loop's values do not fill its rows."""


def tokens(text: str) -> Iterator[tuple[str, bool]]:
    """(value, plain): only plain values can be names, loop_ or data_."""
    text = text.replace("\r\n", "\n")
    for m in TOKEN.finditer(text):
        kind = m.lastgroup
        if kind is None:  # a comment
            continue
        value = m[kind]
        if kind == "plain" and (value[0] in "'\"" or value[0] == ";" and (m.start() == 0 or text[m.start() - 1] == "\n")):
            raise CifError(f"a value that begins with {value[0]} is not closed")
        yield value, kind == "plain"


def categories(text: str, wanted: Iterable[str] | None = None) -> Iterator[tuple[str, int, dict[str, str]]]:
    """(category, row number, values by item) of loops and of single values, of which a category makes one row.

    A row is handed on once it is full, so that an error may come after rows.
    """
    wanted = None if wanted is None else {w.lower() for w in wanted}
    single: dict[str, dict[str, str]] = {}
    names: list[str] = []
    values: list[str] = []
    state = "free"  # free, names (of a loop), values (of a loop) or item (a value is due)

    n = 0  # rows of the loop so far

    def closed():
        if names and values:
            raise CifError(f"{n * len(names) + len(values)} values do not fill rows of {len(names)}")
        names.clear()
        values.clear()

    item = ""
    for value, plain in tokens(text):
        if state == "item":
            category, _, name = item.partition(".")
            single.setdefault(category.lower(), {})[name] = value
            state = "free"
        elif plain and (value == "loop_" or value == "stop_" or value.startswith("data_")):
            closed()
            n = 0
            state = "names" if value == "loop_" else "free"
        elif plain and value.startswith("_"):
            if state == "names":
                names.append(value)
            else:
                closed()
                item, state = value, "item"
        elif state in ("names", "values"):
            state = "values"
            if names:
                values.append(value)
                if len(values) == len(names):
                    category = names[0].partition(".")[0].lower()
                    if wanted is None or category in wanted:
                        yield category, n, dict(zip([name.partition(".")[2] for name in names], values, strict=True))
                    values.clear()
                    n += 1
    closed()
    for category, row in single.items():
        if wanted is None or category in wanted:
            yield category, 0, row


def _rows(batches, wanted: tuple[str, ...] | None):
    item = pa.map_(pa.string(), pa.string())
    schema = pa.schema([("path", pa.string()), ("category", pa.string()), ("row_no", pa.int64()), ("item", item), ("error", pa.string())])
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
    for b in batches:
        out = []
        for path, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text, begun = text.as_py() or "", len(out)
            long = len(text) > LONG
            try:
                if long:  # read once for errors, and again for rows, which need not be held then
                    for _ in categories(text, ()):
                        pass
                for category, row_no, values in categories(text, wanted):
                    out.append((path, category, row_no, list(values.items()), None))
                    if long and len(out) >= ROWS:
                        yield batch(out)
                        out, begun = [], 0
            except CifError as e:
                del out[begun:]
                out.append((path, None, None, None, str(e)))
            if len(out) >= ROWS:
                yield batch(out)
                out = []
        if out:
            yield batch(out)


def cif_rows(files: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Files (path, text) to (path, category, row_no, item map, error); a file that is no CIF is one row with an error and no values."""
    rows = files.select(F.col("path").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda it: _rows(it, wanted), "path string, category string, row_no long, item map<string,string>, error string")


def residue(code: Column) -> Column:
    """One letter of a residue; null for any other."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in RESIDUES.items() for x in kv]), code)


def alpha_carbons(rows: DataFrame, number: str = "label_seq_id", chain: str = "label_asym_id", any_alternative: bool = False, strict: bool = False) -> DataFrame:
    """(path, row_no, chain, number, aa, x, y, z, b) of alpha carbons of standard residues in model 1, first alternative.

    Rows whose numbers do not parse are left out, or are an error if strict.
    """
    v = lambda name: F.element_at("item", F.lit(name))
    ok = (v("label_atom_id") == "CA") & residue(v("label_comp_id")).isNotNull() & (v("pdbx_PDB_model_num") == "1")
    if not any_alternative:
        ok = ok & v("label_alt_id").isin(".", "?", "", "A")
    cast = (lambda c, t: c.cast(t)) if strict else (lambda c, t: c.try_cast(t))
    atoms = rows.where(F.col("category") == "_atom_site").where(ok).select(
        "path", "row_no", v(chain).alias("chain"), cast(v(number), "int").alias("number"), residue(v("label_comp_id")).alias("aa"),
        cast(v("Cartn_x"), "double").alias("x"), cast(v("Cartn_y"), "double").alias("y"), cast(v("Cartn_z"), "double").alias("z"), cast(v("B_iso_or_equiv"), "double").alias("b"),
    )
    return atoms.where(" and ".join(f"{c} is not null" for c in ("number", "x", "y", "z", "b")))


def polymer_sequence(rows: DataFrame) -> DataFrame:
    """(path, entity, number, aa): the first residue listed for a number; X for one that is not standard."""
    v = lambda name: F.element_at("item", F.lit(name))
    listed = rows.where(F.col("category") == "_entity_poly_seq").select("path", "row_no", v("entity_id").alias("entity"), v("num").try_cast("int").alias("number"), F.coalesce(residue(v("mon_id")), F.lit("X")).alias("aa"))
    return listed.where("number is not null").groupBy("path", "entity", "number").agg(F.min_by("aa", "row_no").alias("aa"))


def first_model(rows: DataFrame) -> DataFrame:
    """Atom rows of the model that a file lists first."""
    atoms = rows.where(F.col("category") == "_atom_site").withColumn("model", F.element_at("item", F.lit("pdbx_PDB_model_num")))
    first = atoms.groupBy("path").agg(F.min_by("model", "row_no").alias("first"))
    return atoms.join(first, "path").where(F.col("model") == F.col("first")).drop("model", "first")


def first_chain(atoms: DataFrame) -> DataFrame:
    """Atoms of the chain that a file lists first."""
    first = atoms.groupBy("path").agg(F.min_by("chain", "row_no").alias("first"))
    return atoms.join(first, "path").where(F.col("chain") == F.col("first")).drop("first")
