"""Element symbols, average and main isotope masses, and usual valences of organic elements."""

# symbol: (number, average mass, mass of the most common isotope)
MASSES = {
    "H": (1, 1.008, 1.00782503207), "Li": (3, 6.941, 7.01600455), "B": (5, 10.812, 11.0093054), "C": (6, 12.011, 12.0),
    "N": (7, 14.007, 14.0030740048), "O": (8, 15.999, 15.99491461956), "F": (9, 18.998, 18.99840322),
    "Na": (11, 22.990, 22.9897692809), "Mg": (12, 24.305, 23.9850417), "Al": (13, 26.982, 26.98153863),
    "Si": (14, 28.086, 27.9769265325), "P": (15, 30.974, 30.97376163), "S": (16, 32.067, 31.972071),
    "Cl": (17, 35.453, 34.96885268), "K": (19, 39.098, 38.96370668), "Ca": (20, 40.078, 39.96259098),
    "Fe": (26, 55.845, 55.9349375), "Cu": (29, 63.546, 62.9295975), "Zn": (30, 65.39, 63.9291422),
    "As": (33, 74.922, 74.9215965), "Se": (34, 78.96, 79.9165213), "Br": (35, 79.904, 78.9183371), "Sn": (50, 118.711, 119.9021947),
    "Te": (52, 127.6, 129.9062244), "I": (53, 126.904, 126.904473), "Pt": (78, 195.078, 194.9647911), "Hg": (80, 200.59, 201.970643),
}
NUMBER = {s: v[0] for s, v in MASSES.items()} | {"*": 0}
SYMBOL = {n: s for s, n in NUMBER.items()}
VALENCES = {5: (3,), 6: (4,), 7: (3,), 8: (2,), 9: (1,), 14: (4,), 15: (3, 5, 7), 16: (2, 4, 6), 17: (1,), 35: (1,), 53: (1,), 33: (3, 5), 34: (2, 4, 6), 52: (2, 4, 6)}
METALS = frozenset(NUMBER[s] for s in ("Li", "Na", "Mg", "Al", "K", "Ca", "Fe", "Cu", "Zn", "Sn", "Pt", "Hg"))
