"""Every query of the library with its DuckDB SQL: name -> callable, name -> SQL. Queries run over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.functions import bits, graphs, metrics, scores
from retort.functions import molecule as M
from retort.functions.elements import MASSES
from retort.operators import analysis, brics, columns, conformers, datasets, filters, molecules, reactions, rewrite, similarity, stereo
from retort.plans import library
from retort.sources import formats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "property_rules"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _each(spark, d, made: Callable[[DataFrame], DataFrame], rows=library.bridged) -> DataFrame:
    """Rows of the bridge with what made gives for their molecules: (smiles, mol) in, smiles and new columns out. A molecule is
    read and worked on once for each distinct text of the table (see M.each_text)."""
    return M.each_text(rows(spark, d), lambda texts: made(M.with_molecules(texts)))


def _pieces(spark, d, made, rows=library.bridged) -> DataFrame:
    """The same for operators that give any number of rows a molecule, as (id, ...), for each row of the bridge."""
    found = _each(spark, d, lambda mols: made(mols, id_="smiles").withColumnRenamed("id", "smiles"), rows)
    return found.withColumn("id", F.col("row_idx")).select("id", *[c for c in found.columns if c not in ("row_idx", "mol_id", "smiles", "name")])


# columns

PART = "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"


@query("props_add", f"SELECT {PART}, 'set_a' AS tag FROM part")
def _(spark, d):
    return columns.add(table(spark, d, "part"), "tag", "set_a")


@query("props_rename", "SELECT p_partkey AS id, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def _(spark, d):
    return columns.rename(table(spark, d, "part"), "p_partkey", "id")


@query("props_drop", "SELECT p_partkey, p_brand, p_type, p_size FROM part")
def _(spark, d):
    return columns.drop(table(spark, d, "part"), "p_name", "p_retailprice")


@query("props_keep", "SELECT p_retailprice, p_partkey FROM part")
def _(spark, d):
    return columns.keep(table(spark, d, "part"), "p_retailprice", "p_partkey")


@query("props_list", "SELECT * FROM (VALUES (0, 'p_partkey'), (1, 'p_name'), (2, 'p_brand'), (3, 'p_type'), (4, 'p_size'), (5, 'p_retailprice')) AS t(position, \"column\")")
def _(spark, d):
    return columns.listed(table(spark, d, "part"))


# filters

@query("property_rules", f"SELECT {PART} FROM part WHERE p_size >= 10 AND p_size <= 40 AND p_retailprice > 905 AND p_retailprice <= 1800")
def _(spark, d):
    return filters.by_rules(table(spark, d, "part"), "p_size >= 10", "p_size <= 40", "p_retailprice > 905", "p_retailprice <= 1800")


#: Part columns that stand in for properties where the numbers only have to be compared.
STAND_IN = {"MolWt": "p_retailprice / 2", "MolLogP": "p_size / 8.0", "NumHDonors": "p_size % 9", "NumHAcceptors": "p_size % 15", "TPSA": "p_retailprice / 8", "NumRotatableBonds": "p_size % 13", "NumAtoms": "p_size + 10", "MolMR": "p_retailprice / 10", "RingCount": "p_size % 10"}


def _violations_sql(rules: str) -> str:
    one = []
    for name, (low, high) in filters.RULE_SETS[rules].items():
        v = f"({STAND_IN[name]})"
        out = [f"{v} < {low}"] * (low is not None) + [f"{v} > {high}"] * (high is not None)
        one.append(f"CASE WHEN {' OR '.join(out)} THEN 1 ELSE 0 END")
    return " + ".join(one)


def _failed_sql(rules: str) -> str:
    one = []
    for name, (low, high) in filters.RULE_SETS[rules].items():
        v = f"({STAND_IN[name]})"
        out = [f"{v} < {low}"] * (low is not None) + [f"{v} > {high}"] * (high is not None)
        one.append(f"CASE WHEN {' OR '.join(out)} THEN '{name}' END")
    return f"'Failed: ' || nullif(concat_ws(', ', {', '.join(one)}), '')"


def _druglike(rules: str, spark, d):
    place = {k: F.expr(v) for k, v in STAND_IN.items()}
    out = table(spark, d, "part").select("p_partkey", filters.violations(rules, place).alias("n_violations"), filters.failed_rules(rules, place).alias("reason"), "p_size", "p_retailprice")
    return out.select("p_partkey", "n_violations", "reason")


for _rules in filters.RULE_SETS:
    query(f"druglike_{_rules}", f"SELECT p_partkey, CAST({_violations_sql(_rules)} AS INTEGER) AS n_violations, {_failed_sql(_rules)} AS reason FROM part")(partial(_druglike, _rules))

TOKENS = r"\[[^\]]*\]|Br|Cl|[BCNOPSFIbcnops]"
DIGITS = r"regexp_replace(smiles, '\[[^\]]*\]', 'X', 'g')"
LIB = f"WITH {library.values()}"


@query("element_filter", f"{LIB} SELECT row_idx, name FROM mols WHERE n_s = 0 AND n_na = 0 AND n_br = 0 AND n_f = 0 AND n_n > 0 AND n_cl = 0")
def _(spark, d):
    mols = M.with_molecules(library.bridged(spark, d))
    return mols.where(filters.by_elements(M.elements(), ["C", "H", "N", "O"], ["N"], ["Cl"])).select("row_idx", "name")


@query("heavy_atoms", f"{LIB} SELECT row_idx, CAST(len(regexp_extract_all(smiles, '{TOKENS}')) AS INTEGER) AS heavy_atoms FROM mols")
def _(spark, d):
    return M.with_molecules(library.bridged(spark, d)).select("row_idx", M.DESCRIPTORS["HeavyAtomCount"][1]().alias("heavy_atoms"))


@query("ring_count", f"{LIB} SELECT row_idx, CAST(len(regexp_extract_all({DIGITS}, '[0-9]')) // 2 AS INTEGER) AS ring_count FROM mols")
def _(spark, d):
    return M.with_molecules(library.bridged(spark, d)).select("row_idx", M.DESCRIPTORS["RingCount"][1]().alias("ring_count"))


@query("formula", f"{LIB} SELECT row_idx, formula FROM mols")
def _(spark, d):
    return M.with_molecules(library.bridged(spark, d)).select("row_idx", M.formula().alias("formula"))


_MASS = " + ".join(f"n_{e.lower()} * CAST({MASSES[e][1]} AS DOUBLE)" for e in library.ELEMENTS)
_EXACT = " + ".join(f"n_{e.lower()} * CAST({MASSES[e][2]} AS DOUBLE)" for e in library.ELEMENTS)


@query("mol_weight", f"{LIB} SELECT row_idx, round({_MASS}, 3) AS mol_wt, round({_EXACT}, 4) AS exact_mol_wt FROM mols")
def _(spark, d):
    out = M.descriptors(M.with_molecules(library.bridged(spark, d)), ("MolWt", "ExactMolWt"), None)
    return out.select("row_idx", F.round("MolWt", 3).alias("mol_wt"), F.round("ExactMolWt", 4).alias("exact_mol_wt"))


@query("element_counts", f"{LIB} SELECT row_idx, {', '.join(f'n_{e.lower()}' for e in library.ELEMENTS)} FROM mols")
def _(spark, d):
    counted = M.with_molecules(library.bridged(spark, d)).select("row_idx", M.element_counts().alias("n"))
    return counted.select("row_idx", *(F.coalesce(F.try_element_at("n", F.lit(e)), F.lit(0)).alias(f"n_{e.lower()}") for e in library.ELEMENTS))


@query("fragments_and_charge", f"{LIB} SELECT row_idx, CAST(len(smiles) - len(replace(smiles, '.', '')) + 1 AS INTEGER) AS n_fragments, 0 AS charge, CAST(len(regexp_extract_all(smiles, '[+]')) + len(regexp_extract_all(smiles, '-\\]')) AS INTEGER) AS n_charged FROM mols")
def _(spark, d):
    mols = M.with_molecules(library.bridged(spark, d))
    return mols.select("row_idx", M.DESCRIPTORS["NumFragments"][1]().alias("n_fragments"), M.total(M.m("charge")).alias("charge"), M.count(M.m("charge"), lambda q: q != 0).alias("n_charged"))


@query("complexity_filter", f"{LIB} SELECT row_idx, name FROM mols WHERE len(regexp_extract_all(smiles, '{TOKENS}')) BETWEEN 5 AND 20 AND len(regexp_extract_all({DIGITS}, '[0-9]')) // 2 BETWEEN 1 AND 3")
def _(spark, d):
    out = M.descriptors(M.with_molecules(library.bridged(spark, d)), ("HeavyAtomCount", "RingCount", "NumRotatableBonds"))
    return filters.by_complexity(out, (5, 20), (1, 3), (0, 20)).select("row_idx", "name")


def _mixed(spark, d):
    """Every part with one of the valid or invalid strings."""
    texts = [(k, s) for k, s in enumerate([m[0] for m in library.MOLECULES] + library.INVALID)]
    strings = spark.createDataFrame(texts, "k int, smiles string")
    part = table(spark, d, "part").repartition(spark.sparkContext.defaultParallelism).select(F.col("p_partkey").alias("row_idx"), F.pmod("p_partkey", F.lit(len(texts))).cast("int").alias("k"))
    return part.join(F.broadcast(strings), "k")


_N, _V = len(library.MOLECULES) + len(library.INVALID), len(library.MOLECULES)


@query("validate", f"SELECT p_partkey AS row_idx, p_partkey % {_N} < {_V} AS is_valid, CASE WHEN p_partkey % {_N} < {_V} THEN '' ELSE 'Failed to parse SMILES' END AS errors FROM part")
def _(spark, d):
    return molecules.validate(_mixed(spark, d)).select("row_idx", "is_valid", F.array_join("errors", ";").alias("errors"))


@query("validate_summary", f"SELECT p_partkey % {_N} < {_V} AS is_valid, count(*) AS \"count\", round(count(*) / sum(count(*)) OVER () * 100, 2) AS percentage FROM part GROUP BY 1")
def _(spark, d):
    return datasets.validity(molecules.validate(_mixed(spark, d)))


#: (molecule, text): each of the library's texts, and other spellings of some.
_TEXTS = [(k, m[0]) for k, m in enumerate(library.MOLECULES)] + library.SPELLINGS


@query("canonical_key_partition", f"SELECT count(DISTINCT mol_id) AS n_keys, CAST(0 AS BIGINT) AS mixed, CAST(0 AS BIGINT) AS apart FROM part JOIN (VALUES {', '.join(f'({k}, {n})' for k, (n, _) in enumerate(_TEXTS))}) AS t(k, mol_id) ON p_partkey % {len(_TEXTS)} = k")
def _(spark, d):
    """Keys of all parts' spellings: as many as molecules, none for two molecules, and no molecule with two."""
    rows = library.dealt(spark, d, _TEXTS, "mol_id int, smiles string")
    keys = M.each_text(rows, lambda texts: graphs.key(M.with_molecules(texts, canonical="canonical")).drop("mol")).select("mol_id", "mol_key", "canonical").distinct()
    by_key, by_id = keys.groupBy("mol_key").agg(F.countDistinct("mol_id").alias("n")), keys.groupBy("mol_id").agg(F.countDistinct("mol_key", "canonical").alias("n"))
    a = by_key.agg(F.count("*").alias("n_keys"), F.count(F.when(F.col("n") > 1, 1)).alias("mixed"))
    return a.join(by_id.agg(F.count(F.when(F.col("n") > 1, 1)).alias("apart")))


@query("descriptors_common")
def _(spark, d):
    return _each(spark, d, lambda mols: M.descriptors(mols).drop("mol"))


@query("descriptors_counted", f"{LIB} SELECT row_idx, donors, aromatic, polar FROM mols")
def _(spark, d):
    """Against values counted by hand: donors, aromatic rings, polar surface."""
    made = M.descriptors(M.with_molecules(library.bridged(spark, d)), ("NumHDonors", "NumAromaticRings", "TPSA"), 2)
    return made.select("row_idx", F.col("NumHDonors").cast("int").alias("donors"), F.col("NumAromaticRings").cast("int").alias("aromatic"), F.col("TPSA").alias("polar"))


@query("molecule_info", f"{LIB} SELECT row_idx, formula, CAST(len(regexp_extract_all(smiles, '{TOKENS}')) AS INTEGER) AS heavy_atoms, CAST(len(regexp_extract_all({DIGITS}, '[0-9]')) // 2 AS INTEGER) AS rings, donors, aromatic AS aromatic_rings, polar, 0 AS lipinski_violations FROM mols")
def _(spark, d):
    info = molecules.info(M.with_molecules(library.bridged(spark, d)))
    return info.select("row_idx", "formula", F.col("HeavyAtomCount").alias("heavy_atoms"), F.col("RingCount").alias("rings"), F.col("NumHDonors").alias("donors"), F.col("NumAromaticRings").alias("aromatic_rings"), F.col("TPSA").alias("polar"), "lipinski_violations")


_RINGS = f"CAST(len(regexp_extract_all({DIGITS}, '[0-9]')) // 2 AS INTEGER)"


@query("rings_info", f"{LIB} SELECT row_idx, {_RINGS} AS num_rings, aromatic AS num_aromatic_rings, {_RINGS} - aromatic AS num_aliphatic_rings FROM mols")
def _(spark, d):
    return molecules.ring_info(M.with_molecules(library.bridged(spark, d))).select("row_idx", "num_rings", "num_aromatic_rings", "num_aliphatic_rings")


@query("functional_groups", f"{LIB} SELECT row_idx, {', '.join(f'{library.by_name(v)} AS n_{k}' for k, v in library.GROUPS.items())}, aromatic - {library.by_name(library.FIVE)} AS n_aromatic_ring FROM mols")
def _(spark, d):
    mols = M.with_molecules(library.bridged(spark, d))
    return mols.select("row_idx", *(c.alias(k) for k, c in molecules.functional_groups().items()))


@query("substructure_phenyl", f"{LIB} SELECT row_idx, name FROM mols WHERE name IN ({library.listed(library.PHENYL)})")
def _(spark, d):
    return molecules.substructure(M.with_molecules(library.bridged(spark, d)), "c1ccccc1").select("row_idx", "name")


@query("substructure_acid_excluded", f"{LIB} SELECT row_idx, name FROM mols WHERE name NOT IN ({library.listed(library.CARBOXYL)})")
def _(spark, d):
    return molecules.substructure(M.with_molecules(library.bridged(spark, d)), "C(=O)O", exclude=True).select("row_idx", "name")


@query("stereo_perceive", f"{LIB} SELECT row_idx, {library.by_name(library.CENTERS)} AS n_potential, 0 AS n_specified, {library.by_name(library.CENTERS)} AS n_unspecified FROM mols")
def _(spark, d):
    return molecules.stereo_counts(M.with_molecules(library.bridged(spark, d))).select("row_idx", "n_potential", "n_specified", "n_unspecified")


@query("scaffold_analyze")
def _(spark, d):
    return datasets.frequencies(graphs.scaffold_keys(M.with_molecules(library.bridged(spark, d))), "scaffold_key", top=None)


@query("fingerprint_circular")
def _(spark, d):
    fp = graphs.circular(M.with_molecules(library.bridged(spark, d)))
    return fp.select("row_idx", bits.to_hex(F.col("words")).alias("hex"))


@query("fingerprint_paths")
def _(spark, d):
    fp = graphs.paths(M.with_molecules(library.bridged(spark, d)), 4)
    return fp.select("row_idx", bits.to_hex(F.col("words")).alias("hex"))


@query("mmp_fragment")
def _(spark, d):
    return _pieces(spark, d, molecules.cuts)


@query("mmp_analyze")
def _(spark, d):
    """Transformations between all molecules of the bridge. Rows with equal core and group are counted once with their number,
    so a pair of groups is one row however many molecules have them."""
    return molecules.transformation_counts(_pieces(spark, d, molecules.cuts), 3)


_SALT = "CASE WHEN name = 'sodium benzoate' THEN 'C7H6O2' WHEN name = 'choline chloride' THEN 'C5H14NO+' ELSE formula END"


def _formula_of(df: DataFrame, text: str) -> DataFrame:
    """row_idx and the formula and charge of the molecule that a column spells, read again."""
    read = lambda texts: M.with_molecules(texts).select("smiles", M.formula().alias("formula"), M.total(M.m("charge")).alias("charge"))
    return M.each_text(df.select("row_idx", F.col(text).alias("smiles")), read).drop("smiles")


@query("neutralize", f"{LIB} SELECT row_idx, formula, 0 AS charge FROM mols")
def _(spark, d):
    """What is neutral as a whole stays as it is: salts and nitro groups keep their charges."""
    return _formula_of(_each(spark, d, rewrite.neutralize), "neutralized")


@query("neutralize_ions", f"{LIB} SELECT row_idx, formula, 0 AS charge FROM mols WHERE name IN ('acetamide', 'salicylic acid', 'piperazine', 'taurine', 'imidazole')")
def _(spark, d):
    """Ions of some molecules become these molecules again."""
    ions = {"acetamide": "CC([NH3+])=O", "salicylic acid": "[O-]C(=O)c1ccccc1[O-]", "piperazine": "C1C[NH2+]CC[NH2+]1", "taurine": "[NH3+]CCS(=O)(=O)[O-]", "imidazole": "c1c[n-]cn1"}
    texts = F.create_map(*(F.lit(x) for kv in ions.items() for x in kv))
    rows = library.bridged(spark, d).withColumn("smiles", F.try_element_at(texts, F.col("name"))).where("smiles is not null")
    return _formula_of(M.each_text(rows, lambda texts: rewrite.neutralize(M.with_molecules(texts))), "neutralized")


@query("largest_fragment", f"{LIB} SELECT row_idx, CAST(len(regexp_extract_all(split_part(smiles, '.', 1), '{TOKENS}')) AS INTEGER) AS atoms FROM mols")
def _(spark, d):
    return graphs.largest_fragment(M.with_molecules(library.bridged(spark, d))).select("row_idx", F.size(F.filter("fragment", lambda k: k)).alias("atoms"))


@query("convert", f"{LIB} SELECT row_idx, formula, 0 AS charge FROM mols")
def _(spark, d):
    return _formula_of(rewrite.convert(_mixed_names(spark, d)), "smiles")


def _mixed_names(spark, d):
    """The bridge and as many rows again that are no molecules."""
    rows = library.bridged(spark, d)
    return rows.unionByName(rows.withColumn("smiles", F.lit(library.INVALID[0])))


@query("scaffold_murcko", f"{LIB} SELECT row_idx, framework AS atoms, CAST(CASE WHEN framework > 0 THEN aromatic ELSE 0 END AS INTEGER) AS aromatic_rings FROM mols")
def _(spark, d):
    """Atoms and aromatic rings of each scaffold's text, read again."""
    rows = _each(spark, d, rewrite.scaffolds).select("row_idx", F.col("scaffold").alias("smiles"))
    zero = lambda c: F.when(F.col("mol").isNotNull(), c).when(F.col("smiles") == "", 0)
    again = lambda texts: M.with_molecules(texts).select("smiles", zero(F.size(M.m("z"))).alias("atoms"), zero(M.aromatic_rings()).alias("aromatic_rings"))
    return M.each_text(rows, again).drop("smiles")


@query("rings_extract")
def _(spark, d):
    return _pieces(spark, d, rewrite.ring_systems)


@query("rings_analyze")
def _(spark, d):
    return datasets.frequencies(_pieces(spark, d, rewrite.ring_systems), "ring_system", "id", None)


@query("fragment_recap")
def _(spark, d):
    return _pieces(spark, d, rewrite.fragments)


@query("fragment_analyze")
def _(spark, d):
    return datasets.frequencies(_pieces(spark, d, rewrite.fragments), "fragment_smiles", "id", None)


_BRICS = ", ".join(f"('{n}', '{x}')" for n, x in library.BRICS.items())


@query("fragment_brics_bonds", f"{LIB}, cuts AS (SELECT * FROM (VALUES {_BRICS}) AS t(name, kinds)) SELECT row_idx, coalesce(kinds, '') AS kinds, CAST(CASE WHEN kinds IS NULL THEN 0 ELSE len(string_split(kinds, ' ')) END AS INTEGER) AS n_cuts FROM mols LEFT JOIN cuts USING (name)")
def _(spark, d):
    rows = M.with_molecules(library.bridged(spark, d)).select("row_idx", brics.cuts().alias("cuts"))
    kind = F.transform("cuts", lambda c: F.concat_ws("-", F.least(c["x"], c["y"]), F.greatest(c["x"], c["y"])))
    return rows.select("row_idx", F.array_join(F.array_sort(kind), " ").alias("kinds"), F.size("cuts").alias("n_cuts"))


#: Atoms of the pieces that a molecule has more than once, without the first.
_AGAIN = {"benzophenone": 6, "biphenyl": 6, "diphenylamine": 6, "phenytoin": 6, "procaine": 2, "stilbene": 7, "triethylamine": 4}


@query("fragment_brics_atoms", f"{LIB} SELECT row_idx AS id, CAST(n_c + n_n + n_o + n_s + n_f + n_cl + n_br + n_na - {library.by_name(_AGAIN)} AS BIGINT) AS atoms FROM mols")
def _(spark, d):
    """Atoms of the distinct pieces of each molecule."""
    return _pieces(spark, d, brics.fragments).groupBy("id").agg(F.sum("heavy_atom_count").alias("atoms"))


@query("fragment_brics")
def _(spark, d):
    return _pieces(spark, d, brics.fragments)


@query("fragment_brics_build")
def _(spark, d):
    """The first 1000 molecules of two pieces from the table's molecules."""
    return brics.built(_pieces(spark, d, brics.fragments), 1000)


@query("fragment_build")
def _(spark, d):
    return rewrite.recombined(_pieces(spark, d, rewrite.fragments), 1000)


@query("standardize")
def _(spark, d):
    return _each(spark, d, rewrite.standardize)


@query("standardize_formula", f"{LIB} SELECT row_idx, {_SALT} AS formula, CASE WHEN name = 'choline chloride' THEN 1 ELSE 0 END AS charge FROM mols")
def _(spark, d):
    """The formula and charge of each standardized text, read again."""
    return _formula_of(_each(spark, d, rewrite.standardize), "standardized")


@query("mmp_transform")
def _(spark, d):
    return rewrite.transformed(_pieces(spark, d, molecules.cuts), "C(*)>>O(*)")


@query("props_crippen")
def _(spark, d):
    return rewrite.crippen_atoms(M.with_molecules(library.bridged(spark, d))).drop("mol")


@query("props_charges")
def _(spark, d):
    return rewrite.partial_charges(M.with_molecules(library.bridged(spark, d))).drop("mol")


REACTIONS = [(0, "[C:1]=[O:2]>>[C:1][O:2]"), (1, "[CH3:1]Br>>[CH3:1]O"), (2, "[N:1][C:2]>>[N:1]=[C:2]")]


@query("reactions_map", "SELECT p_partkey AS id, map_num, reactant_idx, product_idx, symbol FROM part JOIN (VALUES (0, 1, 0, 0, 'C'), (0, 2, 1, 1, 'O'), (1, 1, 0, 0, 'C'), (2, 1, 0, 0, 'N'), (2, 2, 1, 1, 'C')) AS t(k, map_num, reactant_idx, product_idx, symbol) ON p_partkey % 3 = k")
def _(spark, d):
    """A reaction for each part."""
    return rewrite.atom_map(library.dealt(spark, d, [r[1:] for r in REACTIONS], "reaction string"))


TEMPLATES = {
    "acetylation": "[NH2:1][c:2]>>CC(=O)[NH:1][c:2]",
    "amide_hydrolysis": "[C:1](=[O:2])[N:3]>>[C:1](=[O:2])O.[N:3]",
    "ester_hydrolysis": "[C:1](=[O:2])[O:3][C:4]>>[C:1](=[O:2])O.[O:3][C:4]",
    "halide_exchange": "[c:1]Cl>>[c:1]O",
    "ketone_reduction": "[C:1][C:2](=[O:3])[C:4]>>[C:1][C:2]([O:3])[C:4]",
    "nitro_reduction": "[N+:1](=[O:2])[O-:3]>>[NH2:1]",
}
#: Formulas of the distinct products of each of the library's molecules that a template fits, worked out by hand.
_PRODUCTS = {
    "acetylation": {"adenine": "C7H7N5O", "aniline": "C8H9NO", "cytosine": "C6H7N3O2", "procaine": "C15H22N2O3", "sulfanilamide": "C8H10N2O3S", "toluidine": "C9H11NO"},
    "amide_hydrolysis": {
        "acetamide": "C2H4O2 H3N", "acetanilide": "C2H4O2 C6H7N", "benzamide": "C7H6O2 H3N", "isoniazid": "C6H5NO2 H4N2", "melatonin": "C2H4O2 C11H14N2O", "niacinamide": "C6H5NO2 H3N", "phenacetin": "C2H4O2 C8H11NO",
        "phenytoin": "C15H14N2O3 C15H14N2O3 C15H14N2O3", "phthalimide": "C8H7NO3", "saccharin": "C7H7NO4S",
    },
    "ester_hydrolysis": {"methyl salicylate": "C7H6O3 CH4O", "procaine": "C7H7NO2 C6H15NO"},
    "halide_exchange": {"bupropion": "C13H19NO2", "chlorobenzene": "C6H6O", "haloperidol": "C21H24FNO3"},
    "ketone_reduction": {"camphor": "C10H18O", "cyclohexanone": "C6H12O"},
    "nitro_reduction": {"nitrophenol": "C6H7NO"},
}
_MADE = ", ".join(f"('{r}', '{n}', '{f}', {len(x.split())})" for r, by in _PRODUCTS.items() for n, x in by.items() for f in x.split())


@query("reactions_transform", f"{LIB}, made AS (SELECT * FROM (VALUES {_MADE}) AS t(reaction, name, formula, num_products)) SELECT reaction, row_idx AS id, made.formula AS formula, CAST(num_products AS INTEGER) AS num_products FROM mols JOIN made USING (name)")
def _(spark, d):
    """Formulas of the products' texts, read again."""

    def made(mols: DataFrame, id_: str) -> DataFrame:
        each = [reactions.transformed(mols, t, id_).withColumn("reaction", F.lit(name)) for name, t in TEMPLATES.items()]
        return M.with_molecules(reduce(DataFrame.unionByName, each), "product").select("id", "reaction", M.formula().alias("formula"), "num_products")

    return _pieces(spark, d, made).select("reaction", "id", "formula", "num_products")


@query("reactions_fingerprint")
def _(spark, d):
    return rewrite.reaction_fingerprints(library.dealt(spark, d, [r[1:] for r in REACTIONS], "reaction string")).withColumn("difference", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("difference")))))


@query("protonate", f"{LIB} SELECT row_idx, {library.by_name(library.CHARGED)} AS charge_at_ph, {library.by_name(library.CHARGED)} AS charge, CAST(n_h + {library.by_name(library.CHARGED)} AS INTEGER) AS hydrogens FROM mols")
def _(spark, d):
    """The charge at pH 7.4, and charge and hydrogens of the text of that state, read again."""
    rows = analysis.protonated(analysis.charge_at(M.with_molecules(library.bridged(spark, d)), 7.4)).select("row_idx", "charge_at_ph", F.col("protonated").alias("smiles"))
    return M.with_molecules(rows).select("row_idx", "charge_at_ph", M.total(M.m("charge")).alias("charge"), M.h_count().alias("hydrogens"))


@query("protonation_sites")
def _(spark, d):
    return analysis.protonation_sites(M.with_molecules(library.bridged(spark, d)))


@query("descriptors_mqn")
def _(spark, d):
    mols = M.with_molecules(library.bridged(spark, d))
    return mols.select("row_idx", *(c.alias(k) for k, c in analysis.quantum_numbers().items()))


@query("pharmacophore_perceive")
def _(spark, d):
    return analysis.pharmacophore(M.with_molecules(library.bridged(spark, d))).drop("mol")


@query("filter_alerts", f"{LIB} SELECT row_idx, name FROM mols WHERE name NOT IN ('benzonitrile', 'nitrophenol')")
def _(spark, d):
    found = analysis.alerts(M.with_molecules(library.bridged(spark, d)), {"nitrile": "C#N", "nitro": "[N+](=O)[O-]"})
    return found.select("row_idx", "name")


@query("enumerate_stereoisomers", f"{LIB}, n AS (SELECT row_idx, {library.by_name(library.CENTERS)} AS k FROM mols) SELECT row_idx AS id, CAST(i AS INTEGER) AS isomer, CASE WHEN k = 0 THEN '' ELSE array_to_string(list_transform(range(0, k), lambda x: (i >> x) & 1), '') END AS assignment FROM (SELECT row_idx, k, unnest(range(0, CAST(2 ** k AS BIGINT))) AS i FROM n)")
def _(spark, d):
    made = analysis.stereoisomers(M.with_molecules(library.bridged(spark, d)))
    return made.select("id", "isomer", F.array_join(F.col("assignment").cast("array<string>"), "").alias("assignment"))


@query("rgroup")
def _(spark, d):
    return analysis.rgroups(M.with_molecules(library.bridged(spark, d)), "c1ccc([*:1])cc1")


@query("scaffold_network")
def _(spark, d):
    return analysis.scaffold_network(_each(spark, d, analysis.scaffold_levels))[0]


@query("fingerprints_list", "SELECT * FROM (VALUES ('circular', 2048, true), ('path', 2048, true), ('atompair', 2048, true), ('torsion', 2048, true), ('maccs', 0, false), ('avalon', 0, false), ('pharmacophore', 0, false)) AS t(name, default_bits, available)")
def _(spark, d):
    return analysis.fingerprint_registry(spark).drop("description")


@query("descriptors_list", "SELECT category, CAST(n AS BIGINT) AS n FROM (VALUES ('constitutional', 27), ('electronic', 70), ('molecular', 7), ('mqn', 42), ('topological', 22)) AS t(category, n)")
def _(spark, d):
    return M.registry(spark).groupBy("category").agg(F.count("*").alias("n"))


#: Valence electrons and masses of the library's elements.
_OUTER = {"c": 4, "h": 1, "n": 5, "o": 6, "s": 6, "f": 7, "cl": 7, "br": 7, "na": 1}
_GRAPH = f"""{LIB}, {library.edges()},
chi0 AS (SELECT mol_id, sum(1 / sqrt(d)) AS x FROM deg GROUP BY mol_id),
chi1 AS (SELECT mol_id, sum(1 / sqrt(x.d * y.d)) AS x FROM edge JOIN deg x USING (mol_id) JOIN deg y USING (mol_id) WHERE x.i = a AND y.i = b GROUP BY mol_id)
SELECT row_idx, round(chi0.x, 4) AS "Chi0", round(chi1.x, 4) AS "Chi1", CAST({" + ".join(f"{v} * n_{e}" for e, v in _OUTER.items())} AS DOUBLE) AS "NumValenceElectrons", CAST(n_n + n_o AS DOUBLE) AS "NOCount",
round({" + ".join(f"{MASSES[e][1]} * n_{e.lower()}" for e in library.ELEMENTS if e != "H")}, 4) AS "HeavyAtomMolWt", CAST(aromatic AS DOUBLE) AS aromatic_rings
FROM mols JOIN chi0 USING (mol_id) JOIN chi1 USING (mol_id)"""


@query("descriptors_graph", _GRAPH)
def _(spark, d):
    """Against sums over bonds that are read off the texts, and against formulas."""
    made = M.descriptors(M.with_molecules(library.bridged(spark, d)), ("Chi0", "Chi1", "NumValenceElectrons", "NOCount", "HeavyAtomMolWt", "NumAromaticCarbocycles", "NumAromaticHeterocycles"))
    return made.select("row_idx", "Chi0", "Chi1", "NumValenceElectrons", "NOCount", "HeavyAtomMolWt", (F.col("NumAromaticCarbocycles") + F.col("NumAromaticHeterocycles")).alias("aromatic_rings"))


@query("descriptors_topological")
def _(spark, d):
    return _each(spark, d, lambda mols: M.descriptors(mols, None, 4, "topological").drop("mol"))


@query("descriptors_surface")
def _(spark, d):
    return _each(spark, d, lambda mols: M.descriptors(mols, None, 4, "electronic").drop("mol"))


@query("descriptors_category", f"{LIB} SELECT row_idx, polar AS \"TPSA\", {library.by_name({'spirodecane': 1})} AS \"NumSpiroAtoms\" FROM mols")
def _(spark, d):
    made = M.descriptors(M.with_molecules(library.bridged(spark, d)), None, 2, "topological", ("NumBridgeheadAtoms",))
    return made.select("row_idx", "TPSA", F.col("NumSpiroAtoms").cast("int").alias("NumSpiroAtoms"))


@query("filter_druglike_molecules", f"{LIB} SELECT row_idx, name FROM mols")
def _(spark, d):
    """All molecules of the library keep to the rule."""
    made = M.descriptors(M.with_molecules(library.bridged(spark, d)), M.LIPINSKI)
    return filters.druglike(made, "lipinski").select("row_idx", "name")


@query("filter_fragment_like", f"{LIB} SELECT row_idx, name FROM mols WHERE donors <= 1 AND polar <= 40 AND {_MASS} <= 150")
def _(spark, d):
    made = M.descriptors(M.with_molecules(library.bridged(spark, d)), ("MolWt", "NumHDonors", "TPSA"))
    rules = {"MolWt": (None, 150), "NumHDonors": (None, 1), "TPSA": (None, 40)}
    return filters.druglike(made, rules).select("row_idx", "name")


#: Spelled once more, no molecule has another fingerprint or key.
_KINDS = ("atompair", "circular", "key", "minhash", "path", "scaffold", "torsion")


@query("fingerprint_spellings", f"SELECT kind, CAST(count(*) AS INTEGER) AS spellings, CAST(0 AS INTEGER) AS apart FROM part, (VALUES {', '.join('(%r)' % k for k in _KINDS)}) AS t(kind) GROUP BY kind")
def _(spark, d):
    """By kind of fingerprint or key: parts' spellings, and how many have another value than the library's own text."""
    rows = library.dealt(spark, d, [(k, s, library.MOLECULES[k][0]) for k, s in library.SPELLINGS], "mol_id int, smiles string, own string")

    def values(c: str) -> DataFrame:
        def made(texts: DataFrame) -> DataFrame:
            mols = M.with_molecules(texts)
            for kind, make in (("circular", graphs.circular), ("path", lambda df, out: graphs.paths(df, 4, out=out)), ("torsion", graphs.torsions), ("atompair", graphs.atom_pairs), ("minhash", scores.minhash_circular)):
                mols = make(mols, out=f"_{kind}").withColumn(kind, bits.to_hex(F.col(f"_{kind}")))
            return graphs.scaffold_keys(graphs.key(mols, "key")).withColumn("scaffold", F.concat_ws("/", "scaffold_key", "generic_key")).select("smiles", *_KINDS)

        mols = M.each_text(rows.select("mol_id", F.col(c).alias("smiles")), made)
        return mols.select("mol_id", F.explode(F.create_map(*(x for k in _KINDS for x in (F.lit(k), F.col(k))))).alias("kind", c))

    met = values("smiles").join(values("own").distinct(), ["mol_id", "kind"])
    return met.groupBy("kind").agg(F.count("*").cast("int").alias("spellings"), F.sum((F.col("smiles") != F.col("own")).cast("int")).cast("int").alias("apart"))


@query("scores")
def _(spark, d):
    return _each(spark, d, lambda mols: scores.accessibility(mols).withColumn("qed", scores.qed()).drop("mol"))


@query("scaffold_side_chains")
def _(spark, d):
    return rewrite.side_chains(M.with_molecules(library.bridged(spark, d))).drop("mol")


@query("fingerprint_minhash")
def _(spark, d):
    fp = _each(spark, d, lambda mols: scores.minhash_circular(mols).drop("mol"))
    return fp.select("row_idx", bits.to_hex(F.col("words")).alias("hex"))


@query("fingerprint_torsions")
def _(spark, d):
    return graphs.torsions(M.with_molecules(library.bridged(spark, d))).select("row_idx", bits.to_hex(F.col("words")).alias("hex"))


@query("fingerprint_atom_pairs")
def _(spark, d):
    return graphs.atom_pairs(M.with_molecules(library.bridged(spark, d))).select("row_idx", bits.to_hex(F.col("words")).alias("hex"))


@query("similarity_molecules")
def _(spark, d):
    """All molecules of the bridge against aspirin."""
    fps = graphs.circular(M.with_molecules(library.bridged(spark, d)))
    query_ = graphs.circular(M.with_molecules(spark.createDataFrame([(library.MOLECULES[0][0],)], "smiles string"))).first()["words"]
    return similarity.search(fps, list(query_), "tanimoto", 2048, 0.2).select("row_idx", "name", "similarity")


# whole datasets


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("row_idx"), "text", "lang", "source")


@query("dedupe_first", "SELECT min(doc_id) AS row_idx FROM documents WHERE text IS NOT NULL GROUP BY text UNION ALL SELECT doc_id FROM documents WHERE text IS NULL")
def _(spark, d):
    return datasets.deduplicate(_docs(spark, d), "text").select("row_idx")


@query("dedupe_last", "SELECT max(doc_id) AS row_idx FROM documents WHERE text IS NOT NULL GROUP BY text UNION ALL SELECT doc_id FROM documents WHERE text IS NULL")
def _(spark, d):
    return datasets.deduplicate(_docs(spark, d), "text", keep="last").select("row_idx")


@query("dedupe_null_key", "SELECT row_idx, user_id FROM (SELECT event_id AS row_idx, user_id, nullif(user_id % 7, 0) AS k, row_number() OVER (PARTITION BY nullif(user_id % 7, 0) ORDER BY event_id) AS r FROM events) WHERE k IS NULL OR r = 1")
def _(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("row_idx"), "user_id")
    return datasets.deduplicate(rows, F.nullif(F.col("user_id") % 7, F.lit(0)))


@query("merge_source", "SELECT c_custkey AS key, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS source_file FROM customer UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal, NULL, 'supplier' FROM supplier")
def _(spark, d):
    return datasets.merge(_sides(spark, d), source_column="source_file").drop("row_idx")


def _sides(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("row_idx"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("row_idx"))
    return {"customer": c, "supplier": s}


@query("merge_dedupe", "SELECT key, balance, source_file FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY part, key) AS r FROM (SELECT c_custkey AS key, c_nationkey AS nation, c_acctbal AS balance, 'customer' AS source_file, 0 AS part FROM customer UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal, 'supplier', 1 FROM supplier)) WHERE r = 1")
def _(spark, d):
    return datasets.merge(_sides(spark, d), "nation", "source_file").select("key", "balance", "source_file")


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("row_idx"), "o_totalprice", "o_orderstatus")


_DRAW = "md5(CAST(o_orderkey AS VARCHAR) || ':42')"


@query("sample_n", f"SELECT o_orderkey AS row_idx, o_totalprice, o_orderstatus FROM orders ORDER BY {_DRAW}, o_orderkey LIMIT 100")
def _(spark, d):
    return datasets.sample(_orders(spark, d), n=100)


@query("sample_fraction", f"SELECT o_orderkey AS row_idx, o_totalprice, o_orderstatus FROM (SELECT *, row_number() OVER (ORDER BY {_DRAW}, o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r <= greatest(1, CAST(floor(n * 0.05) AS BIGINT))")
def _(spark, d):
    return datasets.sample(_orders(spark, d), fraction=0.05)


@query("sample_stratified", """
WITH s AS (SELECT quality, count(*) AS v FROM labels GROUP BY quality), t AS (SELECT quality, v, sum(v) OVER () AS n FROM s),
q AS (SELECT quality, v, CAST(floor(least(60, n) * v / n::DOUBLE) AS BIGINT) AS k, least(60, n) AS want FROM t),
x AS (SELECT quality, k + CASE WHEN quality = (SELECT min(quality) FROM q) THEN want - (SELECT sum(k) FROM q) ELSE 0 END AS k FROM q),
r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS place FROM labels)
SELECT doc_id AS row_idx, r.quality FROM r JOIN x ON r.quality = x.quality WHERE place <= k""")
def _(spark, d):
    return datasets.sample_stratified(table(spark, d, "labels").select(F.col("doc_id").alias("row_idx"), "quality"), 60, "quality")


@query("sample_reservoir", f"SELECT o_orderkey AS row_idx, o_totalprice, o_orderstatus FROM orders ORDER BY {_DRAW}, o_orderkey LIMIT 37")
def _(spark, d):
    return datasets.reservoir(_orders(spark, d), 37)


@query("split_chunks", "SELECT o_orderkey AS row_idx, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS chunk FROM orders")
def _(spark, d):
    return datasets.split(_orders(spark, d), chunks=7).select("row_idx", "chunk")


@query("split_size", "SELECT o_orderkey AS row_idx, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS chunk FROM orders")
def _(spark, d):
    return datasets.split(_orders(spark, d), size=1000).select("row_idx", "chunk")


def _stats_sql(name: str, columns_: dict[str, str], valid: str) -> str:
    aggs = []
    for c, e in columns_.items():
        v = f"CASE WHEN {valid} THEN CAST({e} AS DOUBLE) END"
        aggs += [f"round(min({v}), 2) AS {c}_min", f"round(max({v}), 2) AS {c}_max", f"round(avg({v}), 2) AS {c}_mean", f"round(median({v}), 2) AS {c}_median", f"round(CASE WHEN count({v}) = 1 THEN 0 ELSE stddev_samp({v}) END, 2) AS {c}_stdev"]
    return f"SELECT count(*) AS total_molecules, count(CASE WHEN {valid} THEN 1 END) AS valid_molecules, count(CASE WHEN NOT ({valid}) THEN 1 END) AS invalid_molecules, round(count(CASE WHEN {valid} THEN 1 END) / CAST(count(*) AS DOUBLE), 4) AS validity_rate, {', '.join(aggs)} FROM {name}"


@query("stats_global", _stats_sql("part", {"p_retailprice": "p_retailprice", "p_size": "p_size"}, "p_size > 5"))
def _(spark, d):
    return datasets.statistics(table(spark, d, "part"), ["p_retailprice", "p_size"], F.col("p_size") > 5)


@query("stats_one_row", _stats_sql("region", {"r_regionkey": "r_regionkey"}, "r_regionkey = 2"))
def _(spark, d):
    return datasets.statistics(table(spark, d, "region"), ["r_regionkey"], F.col("r_regionkey") == 2)


@query("freq_top_n", "SELECT p_brand, count(*) AS \"count\", round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100, 2) AS percentage FROM part GROUP BY p_brand ORDER BY count(*) DESC, min(p_partkey) LIMIT 20")
def _(spark, d):
    return datasets.frequencies(table(spark, d, "part"), "p_brand", "p_partkey", 20)


@query("freq_all_sources", "SELECT source, count(*) AS \"count\", round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100, 2) AS percentage FROM documents WHERE source IS NOT NULL GROUP BY source")
def _(spark, d):
    return datasets.frequencies(table(spark, d, "documents"), "source", "doc_id", None)


@query("freq_skip_empty", "SELECT k, count(*) AS \"count\", round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100, 2) AS percentage FROM (SELECT replace(event_type, 'view', '') AS k FROM events) WHERE k <> '' GROUP BY k")
def _(spark, d):
    rows = table(spark, d, "events").select(F.expr("replace(event_type, 'view', '')").alias("k"), "event_id")
    return datasets.frequencies(rows, "k", "event_id", None, True)


@query("mmp_pairs", "SELECT a.l_orderkey AS core, a.l_partkey AS id_1, b.l_partkey AS id_2, CAST(a.l_suppkey AS VARCHAR) || '>>' || CAST(b.l_suppkey AS VARCHAR) AS transformation FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 10) a JOIN (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 10) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey AND a.l_suppkey <> b.l_suppkey")
def _(spark, d):
    """Orders stand in for cores, parts for molecules and suppliers for what differs."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("core"), F.col("l_partkey").alias("id"), F.col("l_suppkey").cast("string").alias("rgroup"), F.col("l_quantity").alias("core_heavy"))
    rows = rows.where("core_heavy >= 10").select("core", "id", "rgroup", F.lit(10).alias("core_heavy")).distinct()
    return molecules.matched_pairs(rows, 10).select("core", "id_1", "id_2", "transformation")


@query("enumerate_product", "SELECT r_name || '.' || n_name AS product FROM region CROSS JOIN nation ORDER BY 1 LIMIT 1000")
def _(spark, d):
    a, b = table(spark, d, "region").select("r_name"), table(spark, d, "nation").select("n_name")
    return molecules.enumerate_products([a, b], F.concat("r_name", F.lit("."), "n_name"))


# similarity: signs of embeddings are fingerprints of 64 bits

N_BITS = 64


def _fps(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x > 0).alias("flags"))
    return rows.select("id", bits.words_from_flags(F.col("flags"), N_BITS).alias("words"))


def _on(spark, d):
    return _fps(spark, d).select("id", bits.on_bits(F.col("words")).alias("on"))


_FP = "fp AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS f FROM embeddings)"
_POP = "pop AS (SELECT id, f, CAST(list_sum(f) AS DOUBLE) AS pop FROM fp)"
_COMMON = "CAST(list_sum(list_transform(list_zip(x.f, y.f), lambda z: z[1] * z[2])) AS DOUBLE)"
_PAIRS = f"pairs AS (SELECT x.id AS i, y.id AS j, x.pop AS a, y.pop AS b, {_COMMON} AS c, CAST({N_BITS} AS DOUBLE) AS n FROM pop x JOIN pop y ON x.id < y.id)"
_FIRST = f"one AS (SELECT y.id, x.pop AS b, y.pop AS a, {_COMMON} AS c, CAST({N_BITS} AS DOUBLE) AS n FROM pop x, pop y WHERE x.id = (SELECT min(id) FROM pop))"


_MANY = f"SELECT y.id AS query_id, x.id AS id, x.pop AS a, y.pop AS b, {_COMMON} AS c, CAST({N_BITS} AS DOUBLE) AS n FROM pop x JOIN pop y ON y.id % 100 = 0"


@query("sim_search_many", f"WITH {_FP}, {_POP}, m AS ({_MANY}) SELECT query_id, id, round(s, 4) AS similarity FROM (SELECT query_id, id, {metrics.sql('tanimoto')} AS s FROM m) WHERE s >= 0.5")
def _(spark, d):
    """Every row whose id is divisible by 100 as a query, against all rows."""
    fps = _fps(spark, d)
    queries = fps.where("id % 100 = 0").select(F.col("id").alias("query_id"), "words")
    return similarity.search_many(fps, queries, "tanimoto", N_BITS, 0.5).withColumn("similarity", F.round("similarity", 4))


def _search(metric: str, spark, d):
    fps = _fps(spark, d)
    first = fps.orderBy("id").first()
    return similarity.search(fps, list(first["words"]), metric, N_BITS, 0.3).select("id", "similarity")


for _m in metrics.FORMULAS:
    query(f"sim_search_{_m}", f"WITH {_FP}, {_POP}, {_FIRST} SELECT id, round(s, 4) AS similarity FROM (SELECT id, {metrics.sql(_m)} AS s FROM one) WHERE s >= 0.3")(partial(_search, _m))


@query("sim_search_top", f"WITH {_FP}, {_POP}, {_FIRST} SELECT id, round(s, 4) AS similarity FROM (SELECT id, {metrics.sql('tanimoto')} AS s FROM one) ORDER BY s DESC, id LIMIT 10")
def _(spark, d):
    fps = _fps(spark, d)
    return similarity.search(fps, list(fps.orderBy("id").first()["words"]), "tanimoto", N_BITS, 0.0, top=10).select("id", "similarity")


@query("sim_matrix", f"WITH {_FP}, {_POP}, {_PAIRS}, h AS (SELECT i, j, {metrics.sql('tanimoto')} AS similarity FROM pairs) SELECT * FROM h UNION ALL SELECT j, i, similarity FROM h UNION ALL SELECT id, id, CAST(1 AS DOUBLE) FROM pop")
def _(spark, d):
    return similarity.matrix(_fps(spark, d), "tanimoto", N_BITS)


@query("diversity_analyze", f"WITH {_FP}, {_POP}, {_PAIRS}, h AS (SELECT {metrics.sql('tanimoto')} AS s FROM pairs) SELECT count(*) AS n_pairs, round(avg(s), 4) AS mean_similarity, round(median(s), 4) AS median_similarity, round(min(s), 4) AS min_similarity, round(max(s), 4) AS max_similarity, round(stddev_samp(s), 4) AS stdev_similarity, round(1 - avg(s), 4) AS diversity FROM h")
def _(spark, d):
    return similarity.diversity(_fps(spark, d), "tanimoto", N_BITS)


@query("neighbors_threshold", f"WITH {_FP}, {_POP}, {_PAIRS} SELECT i, j, s AS similarity FROM (SELECT i, j, {metrics.sql('tanimoto')} AS s FROM pairs) WHERE s >= 0.6")
def _(spark, d):
    return similarity.neighbours(_on(spark, d), 0.6, N_BITS)


#: Neighbours both ways, with the number of each row's.
_NEAR = f"near AS (SELECT i, j FROM (SELECT i, j, {metrics.sql('tanimoto')} AS s FROM pairs) WHERE s >= {{0}}), both_ AS (SELECT i, j FROM near UNION ALL SELECT j, i FROM near), lists AS MATERIALIZED (SELECT pop.id, coalesce(list(j) FILTER (WHERE j IS NOT NULL), []) AS near FROM pop LEFT JOIN both_ ON i = pop.id GROUP BY pop.id)"
#: Rows in an order, each taken unless a row taken before is its neighbour.
_TAKEN = "ranked AS MATERIALIZED (SELECT id, near, row_number() OVER (ORDER BY {0}) AS r FROM lists), walk(r, taken) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT walk.r + 1, CASE WHEN list_has_any(near, taken) THEN taken ELSE list_append(taken, id) END FROM walk JOIN ranked ON ranked.r = walk.r + 1), taken AS (SELECT unnest(taken) AS id FROM (SELECT taken FROM walk ORDER BY r DESC LIMIT 1))"


@query(
    "cluster_butina",
    f"WITH RECURSIVE {_FP}, {_POP}, {_PAIRS}, {_NEAR.format(0.6)}, {_TAKEN.format('len(near) DESC, id')}, of_ AS (SELECT l.id, coalesce(t.id, (SELECT arg_min(c.id, struct_pack(a := -len(c.near), b := c.id)) FROM lists c JOIN taken x ON x.id = c.id WHERE list_contains(l.near, c.id))) AS centroid FROM lists l LEFT JOIN taken t ON t.id = l.id), "
    "sizes AS (SELECT centroid, count(*) AS cluster_size FROM of_ GROUP BY centroid) SELECT id, centroid, row_number_ AS cluster, cluster_size FROM of_ JOIN (SELECT *, row_number() OVER (ORDER BY cluster_size DESC, centroid) - 1 AS row_number_ FROM sizes) USING (centroid)",
)
def _(spark, d):
    fps = _fps(spark, d)
    return similarity.butina(fps, similarity.neighbours(_on(spark, d), 0.6, N_BITS))


def _maxmin_sql(k: int) -> str:
    """Picks one after the other, each from the least distances to all before."""
    dist = f"d AS (SELECT i, j, 1 - {metrics.sql('tanimoto')} AS far FROM pairs), dd AS (SELECT i, j, far FROM d UNION ALL SELECT j, i, far FROM d)"
    steps, picked = ["p0 AS (SELECT min(id) AS id FROM pop)"], "SELECT id, 0 AS diversity_rank FROM p0"
    for n in range(1, k):
        steps.append(f"p{n} AS (SELECT i AS id FROM dd JOIN ({picked}) q ON q.id = dd.j WHERE i NOT IN (SELECT id FROM ({picked})) GROUP BY i ORDER BY min(far) DESC, i LIMIT 1)")
        picked += f" UNION ALL SELECT id, {n} FROM p{n}"
    return f"WITH {_FP}, {_POP}, {_PAIRS}, {dist}, {', '.join(s.replace(' AS (', ' AS MATERIALIZED (', 1) for s in steps)} {picked}"


@query("diversity_maxmin", _maxmin_sql(12))
def _(spark, d):
    fps = _fps(spark, d)
    return similarity.maxmin(fps, 12, fps.agg(F.min("id")).first()[0], N_BITS)


@query("diversity_leader", f"WITH RECURSIVE {_FP}, {_POP}, {_PAIRS}, {_NEAR.format(0.5)}, {_TAKEN.format('id')} SELECT id, row_number() OVER (ORDER BY id) - 1 AS diversity_rank FROM taken")
def _(spark, d):
    return similarity.leader(_fps(spark, d), 0.5, N_BITS)


@query("fp_encode", "WITH fp AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END) AS f FROM embeddings) SELECT id, array_to_string(f, '') AS bitstring, CAST(len(list_filter(f, lambda x: x = '1')) AS INTEGER) AS n_on FROM fp")
def _(spark, d):
    return _fps(spark, d).select("id", bits.to_bitstring(F.col("words")).alias("bitstring"), metrics.popcount(F.col("words")).alias("n_on"))


@query("fp_bits", "SELECT vec_id AS id, " + ", ".join(f"CASE WHEN embedding[{k + 1}] > 0 THEN 1 ELSE 0 END AS bit_{k}" for k in range(N_BITS)) + " FROM embeddings")
def _(spark, d):
    return _fps(spark, d).select("id", *bits.to_columns(F.col("words"), N_BITS))


_NIBBLES = "array_to_string(list_transform(range(15, -1, -1), lambda k: format('{:x}', CAST(f[4 * k + 1] + 2 * f[4 * k + 2] + 4 * f[4 * k + 3] + 8 * f[4 * k + 4] AS INTEGER))), '')"


@query("fp_hex", f"WITH {_FP}, h AS (SELECT id, {_NIBBLES} AS hex FROM fp) SELECT id, hex, to_base64(unhex(hex)) AS base64 FROM h")
def _(spark, d):
    return _fps(spark, d).select("id", bits.to_hex(F.col("words")).alias("hex"), bits.to_base64(F.col("words")).alias("base64"))


# conformers: embeddings are read as points

def _points(spark, d):
    xyz = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.transform(F.slice("embedding", 3 * k + 1, 3), lambda x: x.cast("double")))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label"), xyz.alias("xyz"))


@query("rmsd_raw", "WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), r AS (SELECT v AS w FROM e WHERE id = (SELECT min(id) FROM e)) SELECT id, round(sqrt(list_sum(list_transform(list_zip(v[1:63], w[1:63]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 21), 9) AS rmsd FROM e, r")
def _(spark, d):
    rows = _points(spark, d)
    ref = rows.orderBy("id").first()["xyz"]
    return conformers.compare(rows, ref, aligned=False).select("id", F.round("rmsd", 9).alias("rmsd"))


@query("rmsd_aligned")
def _(spark, d):
    rows = _points(spark, d)
    return conformers.compare(rows, rows.orderBy("id").first()["xyz"]).select("id", "rmsd")


@query("shape_descriptors")
def _(spark, d):
    return conformers.shapes(_points(spark, d)).drop("xyz")


@query("torsion_profile", "SELECT user_id AS id, min(value) AS min_energy, max(value) - min(value) AS barrier FROM events GROUP BY user_id")
def _(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("angle"), F.col("value").alias("energy"))
    return conformers.torsion_profile(rows).select("id", "min_energy", "barrier")


@query("best_conformer", "SELECT id, conf, energy FROM (SELECT user_id AS id, event_id AS conf, value AS energy, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r FROM events) WHERE r = 1")
def _(spark, d):
    return conformers.best(table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("conf"), F.col("value").alias("energy")))


# streams

@query("stream_dedupe", "SELECT user_id, CAST(1 AS BIGINT) AS n FROM (SELECT DISTINCT user_id FROM events)")
def _(spark, d):
    """A stream over the events file, deduplicated by user, run over what is there."""
    import uuid

    from retort.functions.checkpoints import shared_folder
    from retort.streaming import operators as streaming

    batch = table(spark, d, "events")
    where = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(batch.schema).parquet(f"{d}/events.parque[t]")
    out = streaming.run_available(spark, streaming.deduplicate(stream, "user_id"), f"{where}/out", f"{where}/state")
    return out.groupBy("user_id").agg(F.count("*").alias("n"))


# sources and sinks: written to the shared folder and read again

_FILES = ("csv", "tsv", "smi", "sdf", "parquet")


def _written(spark, d, kind: str) -> str:
    """A path with the bridge's molecules, in the given format."""
    import uuid

    from retort.functions.checkpoints import shared_folder

    path = f"{shared_folder(spark)}/molecules-{uuid.uuid4().hex}.{kind}"
    mols = library.bridged(spark, d).withColumn("name", F.concat("name", F.lit(" #"), "row_idx")).drop("mol_id")
    if kind == "sdf":
        rows = M.with_molecules(mols)
        bond = lambda x: F.array(x["a"], x["b"], x["o"])
        charged = F.filter(F.transform(M.m("charge"), lambda q, i: F.array(i, q)), lambda x: x[1] != 0)
        symbols = F.transform(M.m("z"), lambda z: F.element_at(F.create_map(*(F.lit(v) for n, x in M.SYMBOL.items() for v in (n, x))), z))
        zero = F.transform(M.m("z"), lambda z: F.array(*(F.lit(0.0) for _ in range(3))))
        rows = rows.where(~F.exists(M.m("arom"), lambda a: a))  # the format has no aromatic atoms
        mols = rows.select("name", symbols.alias("symbols"), zero.alias("xyz"), F.transform(M.bonds(), bond).alias("bonds"), charged.alias("charges"), F.create_map(F.lit("row_idx"), F.col("row_idx").cast("string")).alias("properties"))
    formats.write_molecules(mols, path, kind)
    return path


def _again(kind: str, spark, d):
    rows = formats.read_molecules(spark, _written(spark, d, kind), kind)
    return M.with_molecules(rows.select("name", "smiles")).select("name", M.formula().alias("formula"))


for _kind in _FILES:
    query(f"source_{_kind}", f"{LIB} SELECT name || ' #' || row_idx AS name, formula FROM mols" + (" WHERE aromatic = 0" if _kind == "sdf" else ""))(partial(_again, _kind))


@query("sink_json", f"{LIB} SELECT row_idx, smiles, name || ' #' || row_idx AS name FROM mols")
def _(spark, d):
    return spark.read.schema("row_idx long, smiles string, name string").json(_written(spark, d, "json"))


@query("source_row_count", f"{LIB} SELECT kind, count(*) FILTER (WHERE kind <> 'sdf' OR aromatic = 0) AS n FROM mols, (VALUES {', '.join(f'(%r)' % k for k in _FILES)}) AS t(kind) GROUP BY kind")
def _(spark, d):
    return spark.createDataFrame([(k, formats.row_count(spark, _written(spark, d, k), k)) for k in _FILES], "kind string, n long")


_PATHS = [("a.csv", "csv", True), ("b/c.TSV", "tsv", True), ("d.smi", "smi", False), ("d.smiles", "smi", False), ("e.sdf", "sdf", True), ("e.mol", "sdf", True), ("f.parquet", "parquet", True), ("f.pq/", "parquet", True)]


@query("source_formats", f"SELECT p_partkey AS row_idx, path, kind, header FROM part JOIN (VALUES {', '.join(f'({k}, {p!r}, {f!r}, {h})' for k, (p, f, h) in enumerate(_PATHS))}) AS t(k, path, kind, header) ON p_partkey % {len(_PATHS)} = k")
def _(spark, d):
    """Kind and header of a path for each part; the kinds of endings are a small table."""
    kinds = [(p, formats.detect(p), formats.config(p).has_header) for p, *_ in _PATHS]
    return library.dealt(spark, d, kinds, "path string, kind string, header boolean")


@query("sink_chunks", "SELECT CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 700 AS BIGINT) AS chunk, o_orderkey AS row_idx FROM orders")
def _(spark, d):
    import uuid

    from retort.functions.checkpoints import shared_folder

    path = f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    datasets.write_chunks(datasets.split(_orders(spark, d), size=700), path)
    return spark.read.parquet(path).select(F.col("chunk").cast("long").alias("chunk"), "row_idx")


@query("sim_matrix_wide", f"WITH {_FP}, {_POP}, {_PAIRS}, h AS (SELECT i, j, {metrics.sql('tanimoto')} AS s FROM pairs), f AS (SELECT * FROM h UNION ALL SELECT j, i, s FROM h UNION ALL SELECT id, id, 1.0::DOUBLE FROM pop) SELECT i, {', '.join(f'round(max(s) FILTER (WHERE j = {k}), 4) AS \"{k}\"' for k in range(8))} FROM f WHERE i < 8 AND j < 8 GROUP BY i")
def _(spark, d):
    """The matrix of the eight rows with the smallest ids, one column a row."""
    return similarity.wide_matrix(similarity.matrix(_fps(spark, d).where("id < 8"), "tanimoto", N_BITS))


# stereo

MARKED = f"WITH {library.marked_values()}"


@query("stereo_spellings", f"{MARKED} SELECT row_idx, min(row_idx) OVER (PARTITION BY molecule) AS first_row FROM spelled")
def _(spark, d):
    rows = rewrite.convert(library.spelled(spark, d))
    return rows.join(rows.groupBy("smiles").agg(F.min("row_idx").alias("first_row")), "smiles").select("row_idx", "first_row")


@query("stereo_assign", f"{MARKED} SELECT row_idx, n_r, n_s, n_e, n_z FROM spelled")
def _(spark, d):
    of = lambda xs, x: M.count(F.col(xs), lambda c: c["label"] == x)
    return stereo.assign(library.spelled(spark, d)).select("row_idx", of("cip.atoms", "R").alias("n_r"), of("cip.atoms", "S").alias("n_s"), of("cip.bonds", "E").alias("n_e"), of("cip.bonds", "Z").alias("n_z"))


@query("stereo_clean", f"{MARKED} SELECT row_idx, n_kept FROM spelled")
def _(spark, d):
    return stereo.cleaned(library.spelled(spark, d)).select("row_idx", "n_kept")


@query("stereo_isomers", f"{MARKED} SELECT row_idx AS id, CAST(n_isomers AS BIGINT) AS n_isomers FROM spelled")
def _(spark, d):
    made = _pieces(spark, d, partial(stereo.isomers, only_unassigned=False), library.spelled)
    return made.groupBy("id").agg(F.count("*").alias("n_isomers"))


@query("stereo_undefined", f"{MARKED} SELECT row_idx, n_centers, n_double_bonds FROM spelled")
def _(spark, d):
    rows = stereo.undefined(M.with_molecules(library.spelled(spark, d)))
    return rows.select("row_idx", F.size("open_centers").alias("n_centers"), F.size("open_double_bonds").alias("n_double_bonds"))
