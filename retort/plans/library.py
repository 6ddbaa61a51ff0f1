"""A fixed set of public molecules in alphabetical order, some spelled in another way, and some wrong texts. Formulas and the
other values are from the literature or counted by hand from the structure, independent of this library's parser."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: smiles, name, formula, donors (N with hydrogens, OH and SH), aromatic rings, polar surface of N and O, heavy atoms of the
#: ring framework with what is doubly bonded to it.
MOLECULES = [
    ("CC(N)=O", "acetamide", "C2H5NO", 1, 0, 43.09, 0),
    ("CC(=O)Nc1ccccc1", "acetanilide", "C8H9NO", 1, 1, 29.10, 6),
    ("c1ccc2nc3ccccc3cc2c1", "acridine", "C13H9N", 0, 3, 12.89, 14),
    ("C1C2CC3CC1CC(C2)C3", "adamantane", "C10H16", 0, 0, 0.0, 10),
    ("Nc1ncnc2[nH]cnc12", "adenine", "C5H5N5", 2, 2, 80.48, 9),
    ("Nc1ccccc1", "aniline", "C6H7N", 1, 1, 26.02, 6),
    ("COc1ccccc1", "anisole", "C7H8O", 0, 1, 9.23, 6),
    ("c1ccc2cc3ccccc3cc2c1", "anthracene", "C14H10", 0, 3, 0.0, 14),
    ("NC(=O)c1ccccc1", "benzamide", "C7H7NO", 1, 1, 43.09, 6),
    ("OC(=O)c1ccccc1", "benzoic acid", "C7H6O2", 1, 1, 37.30, 6),
    ("N#Cc1ccccc1", "benzonitrile", "C7H5N", 0, 1, 23.79, 6),
    ("O=C(c1ccccc1)c1ccccc1", "benzophenone", "C13H10O", 0, 2, 17.07, 14),
    ("c1ccc(-c2ccccc2)cc1", "biphenyl", "C12H10", 0, 2, 0.0, 12),
    ("BrC(Br)Br", "bromoform", "CHBr3", 0, 0, 0.0, 0),
    ("CC(NC(C)(C)C)C(=O)c1cccc(Cl)c1", "bupropion", "C13H18ClNO", 1, 1, 29.10, 6),
    ("CC1(C)C2CCC1(C)C(=O)C2", "camphor", "C10H16O", 0, 0, 17.07, 8),
    ("Oc1ccccc1O", "catechol", "C6H6O2", 2, 1, 40.46, 6),
    ("Clc1ccccc1", "chlorobenzene", "C6H5Cl", 0, 1, 0.0, 6),
    ("C[N+](C)(C)CCO.[Cl-]", "choline chloride", "C5H14ClNO", 1, 0, 20.23, 0),
    ("OC(=O)C=Cc1ccccc1", "cinnamic acid", "C9H8O2", 1, 1, 37.30, 6),
    ("O=c1ccc2ccccc2o1", "coumarin", "C9H6O2", 0, 2, 30.21, 11),
    ("C1CCCCC1", "cyclohexane", "C6H12", 0, 0, 0.0, 6),
    ("O=C1CCCCC1", "cyclohexanone", "C6H10O", 0, 0, 17.07, 7),
    ("Nc1cc[nH]c(=O)n1", "cytosine", "C4H5N3O", 2, 1, 71.77, 7),
    ("C1CCC2CCCCC2C1", "decalin", "C10H18", 0, 0, 0.0, 10),
    ("CS(C)(=O)=O", "dimethyl sulfone", "C2H6O2S", 0, 0, 34.14, 0),
    ("C1COCCO1", "dioxane", "C4H8O2", 0, 0, 18.46, 6),
    ("c1ccc(Nc2ccccc2)cc1", "diphenylamine", "C12H11N", 1, 2, 12.03, 13),
    ("CNC(C)C(O)c1ccccc1", "ephedrine", "C10H15NO", 2, 1, 32.26, 6),
    ("CCS", "ethanethiol", "C2H6S", 1, 0, 0.0, 0),
    ("c1ccc2c(c1)Cc1ccccc1-2", "fluorene", "C13H10", 0, 2, 0.0, 13),
    ("O=C(CCCN1CCC(O)(c2ccc(Cl)cc2)CC1)c1ccc(F)cc1", "haloperidol", "C21H23ClFNO2", 1, 2, 40.54, 23),
    ("NCCc1c[nH]cn1", "histamine", "C5H9N3", 2, 1, 54.70, 5),
    ("Oc1ccc(O)cc1", "hydroquinone", "C6H6O2", 2, 1, 40.46, 6),
    ("c1c[nH]cn1", "imidazole", "C3H4N2", 1, 1, 28.68, 5),
    ("NNC(=O)c1ccncc1", "isoniazid", "C6H7N3O", 2, 1, 68.01, 6),
    ("c1ccc2cnccc2c1", "isoquinoline", "C9H7N", 0, 2, 12.89, 10),
    ("CC(C(=O)O)c1cccc(C(=O)c2ccccc2)c1", "ketoprofen", "C16H14O3", 1, 2, 54.37, 14),
    ("CC(=C)C1CCC(C)=CC1", "limonene", "C10H16", 0, 0, 0.0, 6),
    ("CC(=O)NCCc1c[nH]c2ccc(OC)cc12", "melatonin", "C13H16N2O2", 2, 2, 54.12, 9),
    ("CC(C)C1CCC(C)CC1O", "menthol", "C10H20O", 1, 0, 20.23, 6),
    ("COC(=O)c1ccccc1O", "methyl salicylate", "C8H8O3", 1, 1, 46.53, 6),
    ("C1COCCN1", "morpholine", "C4H9NO", 1, 0, 21.26, 6),
    ("NC(=O)c1cccnc1", "niacinamide", "C6H6N2O", 1, 1, 55.98, 6),
    ("O=[N+]([O-])c1ccc(O)cc1", "nitrophenol", "C6H5NO3", 1, 1, 63.37, 6),
    ("C1CC2CCC1C2", "norbornane", "C7H12", 0, 0, 0.0, 7),
    ("CCOc1ccc(NC(C)=O)cc1", "phenacetin", "C10H13NO2", 1, 1, 38.33, 6),
    ("O=C1NC(=O)C(c2ccccc2)(c2ccccc2)N1", "phenytoin", "C15H12N2O2", 2, 2, 58.20, 19),
    ("O=C1NC(=O)c2ccccc21", "phthalimide", "C8H5NO2", 1, 1, 46.17, 11),
    ("C1CNCCN1", "piperazine", "C4H10N2", 2, 0, 24.06, 6),
    ("C1CCNCC1", "piperidine", "C5H11N", 1, 0, 12.03, 6),
    ("CCN(CC)CCOC(=O)c1ccc(N)cc1", "procaine", "C13H20N2O2", 1, 1, 55.56, 6),
    ("CC(C)NCC(O)COc1cccc2ccccc12", "propranolol", "C16H21NO2", 2, 2, 41.49, 10),
    ("c1ncc2[nH]cnc2n1", "purine", "C5H4N4", 1, 2, 54.46, 9),
    ("c1cn[nH]c1", "pyrazole", "C3H4N2", 1, 1, 28.68, 5),
    ("c1cncnc1", "pyrimidine", "C4H4N2", 0, 1, 25.78, 6),
    ("c1cc[nH]c1", "pyrrole", "C4H5N", 1, 1, 15.79, 5),
    ("c1ccc2ncccc2c1", "quinoline", "C9H7N", 0, 2, 12.89, 10),
    ("Oc1cccc(O)c1", "resorcinol", "C6H6O2", 2, 1, 40.46, 6),
    ("O=C1NS(=O)(=O)c2ccccc21", "saccharin", "C7H5NO3S", 1, 1, 63.24, 12),
    ("OC(=O)c1ccccc1O", "salicylic acid", "C7H6O3", 2, 1, 57.53, 6),
    ("O=C([O-])c1ccccc1.[Na+]", "sodium benzoate", "C7H5NaO2", 0, 1, 40.13, 6),
    ("C1CCC2(C1)CCCCC2", "spirodecane", "C10H18", 0, 0, 0.0, 10),
    ("C(=Cc1ccccc1)c1ccccc1", "stilbene", "C14H12", 0, 2, 0.0, 14),
    ("Nc1ccc(S(N)(=O)=O)cc1", "sulfanilamide", "C6H8N2O2S", 2, 1, 86.18, 6),
    ("NCCS(=O)(=O)O", "taurine", "C2H7NO3S", 2, 0, 80.39, 0),
    ("C1CCOC1", "tetrahydrofuran", "C4H8O", 0, 0, 9.23, 5),
    ("Cn1c(=O)c2[nH]cnc2n(C)c1=O", "theophylline", "C7H8N4O2", 1, 2, 72.68, 11),
    ("c1cscn1", "thiazole", "C3H3NS", 0, 1, 12.89, 5),
    ("Cc1ccc(C(C)C)c(O)c1", "thymol", "C10H14O", 1, 1, 20.23, 6),
    ("Cc1ccc(N)cc1", "toluidine", "C7H9N", 1, 1, 26.02, 6),
    ("CCN(CC)CC", "triethylamine", "C6H15N", 0, 0, 3.24, 0),
    ("NC(Cc1c[nH]c2ccccc12)C(=O)O", "tryptophan", "C11H12N2O2", 3, 2, 79.11, 9),
    ("NC(Cc1ccc(O)cc1)C(=O)O", "tyrosine", "C9H11NO3", 3, 1, 83.55, 6),
    ("O=c1cc[nH]c(=O)[nH]1", "uracil", "C4H4N2O2", 2, 1, 65.72, 8),
    ("COc1cc(C=O)ccc1O", "vanillin", "C8H8O3", 1, 1, 46.53, 6),
    ("Cc1ccccc1C", "xylene", "C8H10", 0, 1, 0.0, 6),
]
PLACE = {m[1]: k for k, m in enumerate(MOLECULES)}
#: Groups of each molecule, counted by hand; those not named have none.
GROUPS = {
    "alcohol": {"benzoic acid": 1, "catechol": 2, "choline chloride": 1, "cinnamic acid": 1, "ephedrine": 1, "haloperidol": 1, "hydroquinone": 2, "ketoprofen": 1, "menthol": 1, "methyl salicylate": 1, "nitrophenol": 1, "propranolol": 1, "resorcinol": 2, "salicylic acid": 2, "taurine": 1, "thymol": 1, "tryptophan": 1, "tyrosine": 2, "vanillin": 1},
    "aldehyde": {"vanillin": 1},
    "ketone": {"benzophenone": 1, "bupropion": 1, "camphor": 1, "cyclohexanone": 1, "haloperidol": 1, "ketoprofen": 1},
    "carboxylic_acid": {"benzoic acid": 1, "cinnamic acid": 1, "ketoprofen": 1, "salicylic acid": 1, "tryptophan": 1, "tyrosine": 1},
    "ester": {"methyl salicylate": 1, "procaine": 1},
    "ether": {"anisole": 1, "dioxane": 2, "melatonin": 1, "methyl salicylate": 1, "morpholine": 1, "phenacetin": 1, "procaine": 1, "propranolol": 1, "tetrahydrofuran": 1, "vanillin": 1},
    "amine_primary": {"acetamide": 1, "adenine": 1, "aniline": 1, "benzamide": 1, "cytosine": 1, "histamine": 1, "niacinamide": 1, "procaine": 1, "sulfanilamide": 1, "taurine": 1, "toluidine": 1, "tryptophan": 1, "tyrosine": 1},
    "amine_secondary": {"acetanilide": 1, "bupropion": 1, "diphenylamine": 1, "ephedrine": 1, "melatonin": 1, "morpholine": 1, "phenacetin": 1, "phenytoin": 2, "phthalimide": 1, "piperazine": 2, "piperidine": 1, "propranolol": 1},
    "amine_tertiary": {"haloperidol": 1, "procaine": 1, "triethylamine": 1},
    "amide": {"acetamide": 1, "acetanilide": 1, "benzamide": 1, "isoniazid": 1, "melatonin": 1, "niacinamide": 1, "phenacetin": 1, "phenytoin": 1, "phthalimide": 2, "saccharin": 1},
    "nitro": {"nitrophenol": 1},
    "nitrile": {"benzonitrile": 1},
    "halogen": {"bromoform": 3, "bupropion": 1, "chlorobenzene": 1, "choline chloride": 1, "haloperidol": 2},
    "thiol": {"ethanethiol": 1},
    "sulfide": {"thiazole": 1},
}
#: Aromatic rings of five atoms.
FIVE = {"adenine": 1, "histamine": 1, "imidazole": 1, "melatonin": 1, "purine": 1, "pyrazole": 1, "pyrrole": 1, "theophylline": 1, "thiazole": 1, "tryptophan": 1}
#: Stereocenters, none of which is specified here.
CENTERS = {"bupropion": 1, "camphor": 2, "ephedrine": 2, "ketoprofen": 1, "limonene": 1, "menthol": 3, "propranolol": 1, "tryptophan": 1, "tyrosine": 1}
#: Charge that the usual pKa of its groups give a molecule at pH 7.4.
CHARGED = {
    "adenine": 1, "aniline": 1, "benzoic acid": -1, "bupropion": 1, "cinnamic acid": -1, "cytosine": 1, "diphenylamine": 1, "ephedrine": 1, "haloperidol": 1, "histamine": 1, "ketoprofen": -1, "morpholine": 1,
    "piperazine": 2, "piperidine": 1, "procaine": 2, "propranolol": 1, "salicylic acid": -1, "sulfanilamide": 1, "toluidine": 1, "triethylamine": 1,
}
#: Molecules with a benzene ring, and with a carbon that has a double and a single bond to oxygens.
PHENYL = [
    "acetanilide", "acridine", "aniline", "anisole", "anthracene", "benzamide", "benzoic acid", "benzonitrile", "benzophenone", "biphenyl", "bupropion", "catechol", "chlorobenzene", "cinnamic acid", "coumarin", "diphenylamine",
    "ephedrine", "fluorene", "haloperidol", "hydroquinone", "isoquinoline", "ketoprofen", "melatonin", "methyl salicylate", "nitrophenol", "phenacetin", "phenytoin", "phthalimide", "procaine", "propranolol", "quinoline",
    "resorcinol", "saccharin", "salicylic acid", "sodium benzoate", "stilbene", "sulfanilamide", "thymol", "toluidine", "tryptophan", "tyrosine", "vanillin", "xylene",
]
CARBOXYL = ["benzoic acid", "cinnamic acid", "ketoprofen", "methyl salicylate", "procaine", "salicylic acid", "sodium benzoate", "tryptophan", "tyrosine"]
#: Kinds of the ends of the bonds that retrosynthesis by sixteen environments cuts, worked out by hand; the lower one first.
BRICS = {
    "acetanilide": "1-5 5-16", "anisole": "3-16", "benzamide": "6-16", "benzoic acid": "6-16", "benzophenone": "6-16 6-16", "biphenyl": "16-16", "bupropion": "4-5 4-5 6-16", "choline chloride": "4-5", "cinnamic acid": "7-7",
    "diphenylamine": "5-16 5-16", "ephedrine": "4-5 8-16", "haloperidol": "15-16 4-5 6-16", "histamine": "8-14", "isoniazid": "6-16", "ketoprofen": "6-16 6-16 8-16", "melatonin": "1-5 3-16 4-5 8-16", "menthol": "8-15",
    "methyl salicylate": "1-3 6-16", "niacinamide": "6-16", "phenacetin": "1-5 3-16 3-4 5-16", "phenytoin": "13-16 13-16", "procaine": "1-3 3-4 4-5 4-5 4-5 6-16", "propranolol": "3-16 3-4 4-5 4-5", "salicylic acid": "6-16",
    "sodium benzoate": "6-16", "stilbene": "7-7", "thymol": "8-16", "triethylamine": "4-5 4-5 4-5", "tryptophan": "8-16", "tyrosine": "8-16", "vanillin": "3-16",
}
#: (name, the same molecule in other words)
SPELLINGS = [
    ("acetanilide", "O=C(C)NC1=CC=CC=C1"), ("anthracene", "C1=CC=C2C=C3C=CC=CC3=CC2=C1"), ("benzoic acid", "O=C(O)C1=CC=CC=C1"), ("bupropion", "Clc1cccc(c1)C(=O)C(C)NC(C)(C)C"), ("catechol", "c1(O)c(O)cccc1"),
    ("choline chloride", "[Cl-].OCC[N+](C)(C)C"), ("coumarin", "O=C1C=CC2=CC=CC=C2O1"), ("cyclohexane", "C%10CCCCC%10"), ("ephedrine", "c1ccccc1C(O)C(C)NC"), ("histamine", "C1=C(CCN)N=CN1"), ("isoquinoline", "C1=CC=C2C=NC=CC2=C1"),
    ("menthol", "OC1CC(C)CCC1C(C)C"), ("nitrophenol", "c1cc(O)ccc1[N+](=O)[O-]"), ("procaine", "Nc1ccc(cc1)C(=O)OCCN(CC)CC"), ("pyrrole", "N1C=CC=C1"), ("quinoline", "C1=CC=C2N=CC=CC2=C1"), ("toluidine", "NC1=CC=C(C)C=C1"),
    ("tryptophan", "OC(=O)C(N)CC1=CNC2=CC=CC=C12"), ("vanillin", "O=Cc1ccc(O)c(OC)c1"), ("xylene", "CC1=CC=CC=C1C"),
]
SPELLINGS = [(PLACE[n], s) for n, s in SPELLINGS]
INVALID = ["no molecule", "CC(=O", "", "c1cccc1", "C1CC", "C(C)(C)(C)(C)C"]
ELEMENTS = ("C", "H", "N", "O", "S", "F", "Cl", "Br", "Na")


def counts(formula: str) -> dict[str, int]:
    found = {e: 0 for e in ELEMENTS}
    for e, n in re.findall(r"([A-Z][a-z]?)(\d*)", formula):
        found[e] += int(n or 1)
    return found


def frame(spark: SparkSession) -> DataFrame:
    rows = [(k, *m[:3]) for k, m in enumerate(MOLECULES)]
    return spark.createDataFrame(rows, "mol_id int, smiles string, name string, formula_lit string")


def bridged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A molecule for each part: (row_idx, mol_id, smiles, name). The library is fixed, so its broadcast is bounded. Parts
    come from one small file, so their keys are dealt to all cores before molecules are parsed."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("row_idx"))
    part = part.repartition(spark.sparkContext.defaultParallelism)
    one = F.pmod("row_idx", F.lit(len(MOLECULES))).cast("int")
    return part.withColumn("mol_id", one).join(F.broadcast(frame(spark).drop("formula_lit")), "mol_id").select("row_idx", "mol_id", "smiles", "name")


def values() -> str:
    """The library as a DuckDB table expression `lib`, with counts from the formulas, and `mols`, a row a part."""
    rows = ", ".join("(" + ", ".join([str(k), f"'{s}'", f"'{n}'", f"'{f}'", *map(str, counts(f).values()), *map(str, more)]) + ")" for k, (s, n, f, *more) in enumerate(MOLECULES))
    names = ", ".join(f"n_{e.lower()}" for e in ELEMENTS)
    return f"lib AS (SELECT * FROM (VALUES {rows}) AS t(mol_id, smiles, name, formula, {names}, donors, aromatic, polar, framework)), mols AS (SELECT p_partkey AS row_idx, lib.* FROM part JOIN lib ON p_partkey % {len(MOLECULES)} = lib.mol_id)"


def skeleton(smiles: str) -> list[tuple[int, int]]:
    """Bonds between the atoms of one of these texts, numbered as written: the texts alone, without this library's parser."""
    bonds, stack, last, n, open_ = [], [], None, 0, {}
    for token in re.findall(r"\[[^\]]*\]|Br|Cl|%\d\d|.", smiles):
        if token == "(":
            stack.append(last)
        elif token == ")":
            last = stack.pop()
        elif token == ".":
            last = None
        elif token[-1].isdigit() and token[0] != "[":
            if token in open_:
                bonds.append((open_.pop(token), last))
            else:
                open_[token] = last
        elif token[0] == "[" or token[0].isalpha():
            if last is not None:
                bonds.append((last, n))
            last, n = n, n + 1
    return bonds


def edges() -> str:
    """Their bonds as a DuckDB table expression `edge`, and `deg`, the number of bonds of each atom."""
    rows = ", ".join(f"({k}, {a}, {b})" for k, (s, *_) in enumerate(MOLECULES) for a, b in skeleton(s))
    return f"edge AS (SELECT * FROM (VALUES {rows}) AS t(mol_id, a, b)), deg AS (SELECT mol_id, i, count(*) AS d FROM (SELECT mol_id, a AS i FROM edge UNION ALL SELECT mol_id, b FROM edge) GROUP BY mol_id, i)"


def by_name(table: dict[str, int], default: int | str = 0) -> str:
    """A DuckDB expression for a value by name."""
    return "CAST(CASE name " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in table.items()) + f" ELSE {default} END AS INTEGER)"


def listed(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)

#: name, R, S, E and Z labels, marks that mean something, isomers, open centers, open double bonds, spellings. Worked out by hand.
MARKED = [
    ("L-alanine", 0, 1, 0, 0, 1, 2, 0, 0, [r"N[C@@H](C)C(=O)O", r"C[C@H](N)C(=O)O", r"OC(=O)[C@@H](N)C"]),
    ("D-alanine", 1, 0, 0, 0, 1, 2, 0, 0, [r"N[C@H](C)C(=O)O", r"C[C@@H](N)C(=O)O"]),
    ("L-cysteine", 1, 0, 0, 0, 1, 2, 0, 0, [r"N[C@@H](CS)C(=O)O", r"SC[C@H](N)C(=O)O"]),
    ("L-threonine", 1, 1, 0, 0, 2, 4, 0, 0, [r"C[C@@H](O)[C@H](N)C(=O)O", r"N[C@@H]([C@@H](C)O)C(=O)O"]),
    ("D-glyceraldehyde", 1, 0, 0, 0, 1, 2, 0, 0, [r"OC[C@@H](O)C=O", r"O=C[C@H](O)CO"]),
    ("(1R,2S,5R)-menthol", 2, 1, 0, 0, 3, 8, 0, 0, [r"CC(C)[C@@H]1CC[C@@H](C)C[C@H]1O", r"C[C@@H]1CC[C@H]([C@@H](C1)O)C(C)C"]),
    ("(R)-limonene", 1, 0, 0, 0, 1, 2, 0, 0, [r"CC(=C)[C@@H]1CCC(C)=CC1", r"CC1=CC[C@@H](CC1)C(=C)C"]),
    ("meso-tartaric acid", 1, 1, 0, 0, 2, 3, 0, 0, [r"OC(=O)[C@@H](O)[C@@H](O)C(=O)O", r"OC(=O)[C@H](O)[C@H](O)C(=O)O"]),
    ("(R,R)-tartaric acid", 2, 0, 0, 0, 2, 3, 0, 0, [r"OC(=O)[C@H](O)[C@@H](O)C(=O)O", r"O[C@@H](C(=O)O)[C@@H](O)C(=O)O"]),
    ("(S,S)-tartaric acid", 0, 2, 0, 0, 2, 3, 0, 0, [r"OC(=O)[C@@H](O)[C@H](O)C(=O)O", r"O[C@H](C(=O)O)[C@H](O)C(=O)O"]),
    ("(S)-1-deuterioethanol", 0, 1, 0, 0, 1, 2, 0, 0, [r"[2H][C@@H](C)O", r"C[C@H]([2H])O"]),
    ("(E)-2-butene", 0, 0, 1, 0, 1, 2, 0, 0, [r"C/C=C/C", r"C\C=C\C", r"C(\C)=C/C"]),
    ("(Z)-2-butene", 0, 0, 0, 1, 1, 2, 0, 0, [r"C/C=C\C", r"C(/C)=C/C"]),
    ("(E,Z)-2,4-hexadiene", 0, 0, 1, 1, 2, 3, 0, 0, [r"C/C=C/C=C\C", r"C/C=C\C=C\C"]),
    ("(E,E)-2,4-hexadiene", 0, 0, 2, 0, 2, 3, 0, 0, [r"C/C=C/C=C/C", r"C(=C/C)\C=C\C"]),
    ("(E)-cinnamic acid", 0, 0, 1, 0, 1, 2, 0, 0, [r"OC(=O)/C=C/c1ccccc1", r"c1ccccc1/C=C/C(O)=O"]),
    ("(E)-cyclooctene", 0, 0, 1, 0, 1, 2, 0, 0, [r"C1CCC/C=C/CC1", r"C/1=C\CCCCCC1"]),
    ("(Z)-1-bromo-2-chloro-2-fluoroethene", 0, 0, 0, 1, 1, 2, 0, 0, [r"F/C(Cl)=C/Br", r"Br/C=C(/F)Cl"]),
    ("cis-1,4-dimethylcyclohexane", 0, 0, 0, 0, 2, 1, 0, 0, [r"C[C@H]1CC[C@@H](C)CC1", r"C[C@@H]1CC[C@H](C)CC1"]),
    ("trans-1,4-dimethylcyclohexane", 0, 0, 0, 0, 2, 1, 0, 0, [r"C[C@H]1CC[C@H](C)CC1", r"C[C@@H]1CC[C@@H](C)CC1"]),
    ("2-propanol", 0, 0, 0, 0, 0, 1, 0, 0, [r"C[C@H](C)O", r"CC(C)O", r"C[C@@H](O)C"]),
    ("methylcyclohexane", 0, 0, 0, 0, 0, 1, 0, 0, [r"C[C@H]1CCCCC1", r"CC1CCCCC1"]),
    ("2-methyl-2-butene", 0, 0, 0, 0, 0, 1, 0, 0, [r"C/C=C(/C)C", r"CC=C(C)C"]),
    ("2-butanol", 0, 0, 0, 0, 0, 2, 1, 0, [r"CCC(C)O", r"OC(C)CC"]),
    ("3-penten-2-ol", 0, 0, 0, 0, 0, 4, 1, 1, [r"CC=CC(C)O", r"OC(C)C=CC"]),
    ("acetaldoxime", 0, 0, 0, 0, 0, 2, 0, 1, [r"CC=NO", r"ON=CC"]),
]
SPELLED = [(k, s) for k, one in enumerate(MARKED) for s in one[-1]]


def dealt(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str) -> DataFrame:
    """One of a few fixed rows, in turn, for each part, with row_idx: row k for p_partkey % len(rows) = k."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("row_idx"))
    part = part.repartition(spark.sparkContext.defaultParallelism)
    few = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"_k int, {schema}")
    return part.withColumn("_k", F.pmod("row_idx", F.lit(len(rows))).cast("int")).join(F.broadcast(few), "_k").drop("_k")


def spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spelling with stereo marks for each part: (row_idx, smiles)."""
    return dealt(spark, sf_dir, [(s,) for _, s in SPELLED], "smiles string")


def marked_values() -> str:
    """The values of MARKED as a DuckDB table expression `spelled`, a row a part."""
    fields = ("n_r", "n_s", "n_e", "n_z", "n_kept", "n_isomers", "n_centers", "n_double_bonds")
    rows = ", ".join("(" + ", ".join(map(str, [k, s, *MARKED[s][1:-1]])) + ")" for k, (s, _) in enumerate(SPELLED))
    return f"spelled AS (SELECT p_partkey AS row_idx, t.* FROM part JOIN (VALUES {rows}) AS t(spelling, molecule, {', '.join(fields)}) ON p_partkey % {len(SPELLED)} = t.spelling)"
