"""Labels of a mapped chain: model and reference atoms are paired, checked, superposed and scored, or a typed status says why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.operators.alignment import align_pairs
from ledgerlake.operators.geometry import _POINTS, _SQUARE, M, R, TOLERANCES, RADIUS, lddt, superpose
from ledgerlake.operators.orderstats import quantiles
from ledgerlake.plans.registry import query
from ledgerlake.sources.cif import RESIDUES, alpha_carbons, cif_rows, polymer_sequence
from ledgerlake.sources.sinks import stored
from ledgerlake.sources.tables import load

#: Least model atoms, least reference atoms and aligned pairs, greatest share of mismatches, and the statuses.
LEAST_MODEL, LEAST_ALIGNED, MOST_MISMATCHES = 3, 30, (1, 10)
FEW_MODEL, FEW_REFERENCE, FEW_ALIGNED = "E422_AF_INSUFFICIENT_CA", "E422_REF_INSUFFICIENT_CA", "E422_INSUFFICIENT_ALIGNED"
NO_CHAIN, OTHER_SEQUENCE = "E427_REF_NO_LABEL_ASYM", "E427_SEQUENCE_IDENTITY_FAILED"


def robust_z(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """rows with (value - median) / interquartile range of the group; a range of zero counts as one."""
    q = quantiles(rows, by, value, [0.25, 0.5, 0.75], "_q")
    width = F.col("_q")[2] - F.col("_q")[0]
    return rows.join(q, by).withColumn(out, (F.col(value) - F.col("_q")[1]) / F.when(width == 0, 1.0).otherwise(width)).drop("_q")


def sequence_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """(*by, numbers, letters): residues by number, as an array and as a text of one letter each."""
    g = rows.groupBy(by).agg(F.sort_array(F.collect_set(F.struct("number", "aa"))).alias("r"))
    return g.select(*by, F.col("r.number").alias("numbers"), F.array_join("r.aa", "").alias("letters"))


def aligned_segments(triples: DataFrame, model: DataFrame, polymer: DataFrame) -> DataFrame:
    """(triple, number, unp) of segments of unequal spans, from identical residues of a global alignment."""
    odd = triples.where("label_end - label_start <> unp_end - unp_start")
    first = odd.join(polymer, (polymer["path"] == odd["ref_path"]) & (polymer["entity"] == odd["entity"]) & polymer["number"].between(odd["label_start"], odd["label_end"])).select("triple", "number", "aa")
    second = odd.join(model, (model["path"] == odd["model_path"]) & model["number"].between(odd["unp_start"], odd["unp_end"])).select("triple", "number", "aa")
    a = sequence_of(first, ["triple"])
    b = sequence_of(second, ["triple"]).withColumnsRenamed({"numbers": "positions", "letters": "others"})
    pairs = a.join(b, "triple").select("triple", "numbers", "positions", F.explode(align_pairs("letters", "others")).alias("p"))
    return pairs.select("triple", F.element_at("numbers", F.col("p.first")).alias("number"), F.element_at("positions", F.col("p.second")).alias("unp"))


def label_triples(triples: DataFrame, model: DataFrame, reference: DataFrame, polymer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statuses (triple, status, n_pairs, n_mismatch, n_aligned), a row a triple, and label rows of those that are ok.

    triples: (triple, ref_path, model_path, asym, entity, label_start, label_end, unp_start, unp_end). model, reference:
    alpha carbons, the model's by position. polymer: residues by entity and number. Label rows: (triple, unp, aa, b of
    the model, d after superposition, lddt, z of the reference's b within its chain).
    """
    m = model.select(F.col("path").alias("model_path"), F.col("number").alias("unp"), F.col("aa").alias("m_aa"), *[F.col(c).alias(f"m{c}") for c in "xyz"], F.col("b").alias("m_b"))
    ref = robust_z(reference, ["path", "chain"], "b", "b_z").select(F.col("path").alias("ref_path"), F.col("chain").alias("asym"), "row_no", "number", F.col("aa").alias("r_aa"), *[F.col(c).alias(f"r{c}") for c in "xyz"], "b_z")
    n_model = m.groupBy("model_path").agg(F.count("*").alias("n_model"))
    n_ref = ref.groupBy("ref_path", "asym").agg(F.count("*").alias("n_ref"))
    even = triples.where("label_end - label_start = unp_end - unp_start").join(ref, ["ref_path", "asym"]).where(F.col("number").between(F.col("label_start"), F.col("label_end")))
    even = even.withColumn("unp", F.col("unp_start") + F.col("number") - F.col("label_start"))
    odd = triples.join(aligned_segments(triples, model, polymer), "triple").join(ref, ["ref_path", "asym", "number"])
    both = even.unionByName(odd).join(m, ["model_path", "unp"])
    same = F.col("r_aa") == F.col("m_aa")
    # once a position has an identical pair, later atoms of it don't count
    done = F.min(F.when(same, F.col("row_no"))).over(W.partitionBy("triple", "unp"))
    pairs = both.withColumn("_done", done).where(F.col("_done").isNull() | (F.col("row_no") <= F.col("_done"))).withColumn("same", same)
    pairs = stored(pairs.select("triple", "unp", "row_no", "same", F.col("m_aa").alias("aa"), *R, *M, "m_b", "b_z"), "pairs")
    told = pairs.groupBy("triple").agg(F.count("*").alias("n_pairs"), F.count_if(~F.col("same")).alias("n_mismatch"))
    each = triples.join(n_model, "model_path", "left").join(n_ref, ["ref_path", "asym"], "left").join(told, "triple", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    few, most = MOST_MISMATCHES
    status = (
        F.when(n("n_model") < LEAST_MODEL, FEW_MODEL).when(F.coalesce("asym", F.lit("")) == "", NO_CHAIN).when(n("n_ref") < LEAST_ALIGNED, FEW_REFERENCE)
        .when(most * n("n_mismatch") > few * n("n_pairs"), OTHER_SEQUENCE).when(n("n_pairs") - n("n_mismatch") < LEAST_ALIGNED, FEW_ALIGNED).otherwise("ok")
    )
    statuses = each.select("triple", status.alias("status"), n("n_pairs").alias("n_pairs"), n("n_mismatch").alias("n_mismatch"), (n("n_pairs") - n("n_mismatch")).alias("n_aligned"))
    ok = pairs.where("same").join(statuses.where("status = 'ok'").select("triple"), "triple")
    p = ok.select(F.col("triple").alias("g"), F.col("unp").alias("id"), *R, *M)
    scored = superpose(p).join(lddt(p), ["g", "id"]).select(F.col("g").alias("triple"), F.col("id").alias("unp"), "d", "lddt")
    return statuses, ok.select("triple", "unp", "aa", "m_b", "b_z").join(scored, ["triple", "unp"])


_CODES = list(RESIDUES)[:20]


def _atoms(number: Column, code: Column, chain: str, xyz: tuple[str, ...], b: Column) -> Column:
    """Lines of an atom: an alternative of another place, the atom itself, and its neighbour that is no alpha carbon."""
    line = lambda atom, alternative, model="1": F.concat_ws(" ", F.lit("ATOM"), F.lit(atom), F.lit(alternative), code, F.lit(chain), number.cast("string"), *[F.col(c).cast("string") for c in xyz], b.cast("string"), F.lit(model))
    return F.concat_ws("\n", line("CA", "B"), line("CA", "."), line('"C\'B"', "."), line("CA", ".", "2"))


_HEAD = "data_x\n# atoms of one entry\n_entry.id 'an entry''s name'\nloop_\n" + "\n".join(f"_atom_site.{c}" for c in ("group_PDB", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "B_iso_or_equiv", "pdbx_PDB_model_num")) + "\n"


def entry_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """CIF texts (path, text) made of the vectors, a reference and a model by label, and the triples that map one to the other.

    The label's last digit decides what is amiss: at 1 every seventh residue differs, at 2 the chain is not named, at 3
    the spans are unequal, so that the sequences must be aligned.
    """
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    d = load(spark, sf_dir, "embeddings").where(F.size("embedding") >= 6).select(F.col("label").alias("g"), F.col("vec_id").cast("int").alias("id"), *[(v(i) * 20).alias(R[i]) for i in range(3)], *[(v(i) * 20 + v(i + 3) * 4).alias(M[i]) for i in range(3)])
    codes = F.array(*map(F.lit, _CODES))
    code = lambda x: F.get(codes, F.pmod(x, F.lit(20)))
    other = F.when((F.pmod("g", F.lit(10)) == 1) & (F.pmod("id", F.lit(7)) == 0), F.col("id") + 1).otherwise(F.col("id"))
    text = lambda lines: F.concat(F.lit(_HEAD), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", lines.alias("l")))), lambda r: r["l"]), "\n"))
    sequence = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", code(F.col("id")).alias("c")))), lambda r: F.concat_ws(" ", F.lit("1"), r["id"].cast("string"), r["c"])), "\n")
    listed = F.concat(F.lit("\nloop_\n_entity_poly_seq.entity_id\n_entity_poly_seq.num\n_entity_poly_seq.mon_id\n"), sequence, F.lit("\n_struct.text\n;free text\nloop_ of lines\n;\n"))
    ref = d.groupBy("g").agg(F.concat(text(_atoms(F.col("id"), code(F.col("id")), "A", R, F.col("id") % 13)), listed).alias("text")).select(F.concat(F.lit("r"), "g").alias("path"), "text")
    model = d.groupBy("g").agg(text(_atoms(F.col("id") + 100, code(other), "A", M, F.lit(90.5))).alias("text")).select(F.concat(F.lit("m"), "g").alias("path"), "text")
    longer = F.when(F.pmod("g", F.lit(10)) == 3, 5).otherwise(0)
    t = d.groupBy("g").agg(F.min("id").alias("label_start"), F.max("id").alias("label_end"))
    triples = t.select(
        F.col("g").alias("triple"), F.concat(F.lit("r"), "g").alias("ref_path"), F.concat(F.lit("m"), "g").alias("model_path"), F.when(F.pmod("g", F.lit(10)) != 2, "A").alias("asym"), F.lit("1").alias("entity"),
        "label_start", "label_end", (F.col("label_start") + 100).alias("unp_start"), (F.col("label_end") + 100 + longer).alias("unp_end"),
    )
    return ref.unionByName(model), triples


def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files, triples = entry_files(spark, sf_dir)
    rows = stored(cif_rows(files, ("_atom_site", "_entity_poly_seq")), "cif")
    atoms = stored(alpha_carbons(rows), "atoms")
    return label_triples(stored(triples, "triples"), atoms.where("path like 'm%'"), atoms.where("path like 'r%'"), polymer_sequence(rows))


_LABELS = f"""{_POINTS}, e AS (SELECT *, g % 10 = 1 AND id % 7 = 0 AS off FROM p),
s AS (SELECT g, count(*) AS n, count(*) FILTER (off) AS mm FROM e GROUP BY g),
st AS (SELECT g AS triple, CASE WHEN n < {LEAST_MODEL} THEN '{FEW_MODEL}' WHEN g % 10 = 2 THEN '{NO_CHAIN}' WHEN n < {LEAST_ALIGNED} THEN '{FEW_REFERENCE}' WHEN 10 * mm > n THEN '{OTHER_SEQUENCE}' WHEN n - mm < {LEAST_ALIGNED} THEN '{FEW_ALIGNED}' ELSE 'ok' END AS status,
       CASE WHEN g % 10 = 2 THEN 0 ELSE n END AS n_pairs, CASE WHEN g % 10 = 2 THEN 0 ELSE mm END AS n_mismatch FROM s)"""


@query(f"WITH {_LABELS} SELECT triple, status, n_pairs, n_mismatch, n_pairs - n_mismatch AS n_aligned FROM st")
def label_statuses(spark, sf_dir):
    """From CIF texts to a typed status by triple."""
    return labelled(spark, sf_dir)[0]


@query(f"""WITH {_LABELS}, o AS (SELECT e.* FROM e JOIN st ON st.triple = e.g WHERE status = 'ok' AND NOT off),
q AS (SELECT a.g, a.id, abs(sqrt({_SQUARE(R)}) - sqrt({_SQUARE(M)})) AS o FROM o a JOIN o b ON a.g = b.g AND a.id <> b.id AND {_SQUARE(R)} < {RADIUS * RADIUS}),
k AS (SELECT g, id, count(*) AS n, {" + ".join(f"count(*) FILTER (o < {t})" for t in TOLERANCES)} AS h FROM q GROUP BY g, id),
z AS (SELECT g, quantile_cont(id % 13, 0.5) AS med, quantile_cont(id % 13, 0.75) - quantile_cont(id % 13, 0.25) AS iqr FROM e GROUP BY g)
SELECT o.g AS triple, o.id + 100 AS unp, CAST(90.5 AS DOUBLE) AS plddt, round(h / CAST(n * {len(TOLERANCES)} AS DOUBLE), 9) AS lddt, round((o.id % 13 - med) / CASE WHEN iqr = 0 THEN 1 ELSE iqr END, 9) AS b_factor_z
FROM o LEFT JOIN k ON k.g = o.g AND k.id = o.id JOIN z ON z.g = o.g""")
def label_rows(spark, sf_dir):
    """Label rows of the triples that are ok; the superposed distance is left to its own query, since SQL has no rotation."""
    rows = labelled(spark, sf_dir)[1]
    return rows.select("triple", "unp", F.col("m_b").alias("plddt"), F.round("lddt", 9).alias("lddt"), F.round("b_z", 9).alias("b_factor_z"))
