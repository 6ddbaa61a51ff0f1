"""Common molecules by name for tests, (smiles, name, formula)."""

MOLECULES = [
    ("CC(C)=O", "acetone", "C3H6O"), ("CC#N", "acetonitrile", "C2H3N"), ("CC(N)C(O)=O", "alanine", "C3H7NO2"), ("CC(=O)Oc1ccccc1C(O)=O", "aspirin", "C9H8O4"), ("c1ccccc1", "benzene", "C6H6"), ("c1ccc(Br)cc1", "bromobenzene", "C6H5Br"),
    ("Cn1c(=O)c2c(ncn2C)n(C)c1=O", "caffeine", "C8H10N4O2"), ("ClC(Cl)Cl", "chloroform", "CHCl3"), ("COC(=O)C1C2CCC(N2C)CC1OC(=O)c1ccccc1", "cocaine", "C17H21NO4"), ("CN1C(=O)CN=C(c2ccccc2)c2cc(Cl)ccc12", "diazepam", "C16H13ClN2O"),
    ("NCCc1ccc(O)c(O)c1", "dopamine", "C8H11NO2"), ("OCC", "ethanol", "C2H6O"), ("o1cccc1", "furan", "C4H4O"), ("OCC1OC(O)C(O)C(O)C1O", "glucose", "C6H12O6"), ("OC(=O)CN", "glycine", "C2H5NO2"), ("CC(Cc1ccc(cc1)C(C)C(O)=O)C", "ibuprofen", "C13H18O2"),
    ("c1ccc2cc[nH]c2c1", "indole", "C8H7N"), ("Cc1cccc(C)c1NC(=O)CN(CC)CC", "lidocaine", "C14H22N2O"), ("CN1CCC23C4Oc5c(O)ccc(CC1C2C=CC4O)c35", "morphine", "C17H19NO3"), ("c1ccc2ccccc2c1", "naphthalene", "C10H8"), ("CN1CCCC1c1cccnc1", "nicotine", "C10H14N2"),
    ("[O-][N+](=O)c1ccccc1", "nitrobenzene", "C6H5NO2"), ("CC(=O)Nc1ccc(O)cc1", "paracetamol", "C8H9NO2"), ("c1ccc(O)cc1", "phenol", "C6H6O"), ("n1ccccc1", "pyridine", "C5H5N"), ("[Na+].[O-]C(C)=O", "sodium acetate", "C2H3NaO2"),
    ("Cc1onc(NS(=O)(=O)c2ccc(N)cc2)c1", "sulfamethoxazole", "C10H11N3O3S"), ("Cc1ccccc1", "toluene", "C7H8"), ("NC(N)=O", "urea", "CH4N2O"),
]
INVALID = ["CC(=O", "", "c1cccc1", "C1CC", "C(C)(C)(C)(C)C"]


def frame(spark):
    return spark.createDataFrame([(k, *m) for k, m in enumerate(MOLECULES)], "mol_id int, smiles string, name string, formula_lit string")
