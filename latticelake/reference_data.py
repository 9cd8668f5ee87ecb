"""Small fixed tables: elements, facets, enumerations, symmetry ranges. All are broadcastable."""

# Symbols by atomic number.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm"
).split()

# Covalent radii in angstrom (Cordero et al. 2008), hydrogen to curium.
RADII = [float(x) for x in (
    "0.31 0.28 1.28 0.96 0.84 0.76 0.71 0.66 0.57 0.58 1.66 1.41 1.21 1.11 1.07 1.05 1.02 1.06 2.03 1.76 1.70 1.60 1.53 1.39 1.39 1.32 1.26 1.24 1.32 1.22 "
    "1.22 1.20 1.19 1.20 1.20 1.16 2.20 1.95 1.90 1.75 1.64 1.54 1.47 1.46 1.42 1.39 1.45 1.44 1.42 1.39 1.39 1.38 1.39 1.40 2.44 2.15 2.07 2.04 2.03 2.01 "
    "1.99 1.98 1.98 1.96 1.94 1.92 1.92 1.89 1.90 1.87 1.87 1.75 1.70 1.62 1.51 1.44 1.41 1.36 1.36 1.32 1.45 1.46 1.48 1.40 1.50 1.50 2.60 2.21 2.15 2.06 "
    "2.00 1.96 1.90 1.87 1.80 1.69").split()]

# Standard atomic masses, hydrogen to curium.
MASSES = [float(x) for x in (
    "1.008 4.0026 6.94 9.0122 10.81 12.011 14.007 15.999 18.998 20.180 22.990 24.305 26.982 28.085 30.974 32.06 35.45 39.948 39.098 40.078 44.956 47.867 50.942 51.996 "
    "54.938 55.845 58.933 58.693 63.546 65.38 69.723 72.630 74.922 78.971 79.904 83.798 85.468 87.62 88.906 91.224 92.906 95.95 98 101.07 102.91 106.42 107.87 112.41 "
    "114.82 118.71 121.76 127.60 126.90 131.29 132.91 137.33 138.91 140.12 140.91 144.24 145 150.36 151.96 157.25 158.93 162.50 164.93 167.26 168.93 173.05 174.97 178.49 "
    "180.95 183.84 186.21 190.23 192.22 195.08 196.97 200.59 204.38 207.2 208.98 209 210 222 223 226 227 232.04 231.04 238.03 237 244 243 247").split()]

# The order of elements in a standard formula; others follow as first seen.
FORMULA_ORDER = (
    "Fr Cs Rb K Na Li Be Mg Ca Sr Ba Ra Sc Y La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Ac Th Pa U Np Pu Ti Zr Hf V Nb Ta Cr Mo W Fe Ru Os Co Rh Ir Mn Tc Re "
    "Ni Pd Pt Cu Ag Au Zn Cd Hg B Al Ga In Tl Pb Sn Ge Si C N P As Sb Bi H Po Te Se S O At I Br Cl F He Ne Ar Kr Xe Rn"
).split()

# Elements of the perovskite sites.
SITE_A = "Li Na K Rb Cs Fr Mg Ca Sr Ba Ra Sc Y La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Ag Pb Bi Th In Mn Zn".split()
SITE_B = "Ti V Cr Mn Fe Co Ni Cu Zn Ga Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Hf Ta W Re Se La Pr Pb".split()
SITE_C = "H O F Cl Br I".split()

# Space-group ranges (first, last, name).
CRYSTAL_SYSTEMS = [(1, 2, "triclinic"), (3, 15, "monoclinic"), (16, 74, "orthorhombic"), (75, 142, "tetragonal"), (143, 167, "trigonal"), (168, 194, "hexagonal"), (195, 230, "cubic")]
POINT_GROUPS = [
    (1, 1, "C<sub>1</sub>"), (2, 2, "C<sub>i</sub>"), (3, 5, "C<sub>2</sub>"), (6, 9, "C<sub>s</sub>"), (10, 15, "C<sub>2h</sub>"), (16, 24, "D<sub>2</sub>"),
    (25, 46, "C<sub>2v</sub>"), (47, 74, "D<sub>2h</sub>"), (75, 80, "C<sub>4</sub>"), (81, 82, "S<sub>4</sub>"), (83, 88, "C<sub>4h</sub>"), (89, 98, "D<sub>4</sub>"),
    (99, 110, "C<sub>4v</sub>"), (111, 122, "D<sub>2d</sub>"), (123, 142, "D<sub>4h</sub>"), (143, 146, "C<sub>3</sub>"), (147, 148, "C<sub>3i</sub>"), (149, 155, "D<sub>3</sub>"),
    (156, 161, "C<sub>3v</sub>"), (162, 167, "D<sub>3d</sub>"), (168, 173, "C<sub>6</sub>"), (174, 174, "C<sub>3h</sub>"), (175, 176, "C<sub>6h</sub>"), (177, 182, "D<sub>6</sub>"),
    (183, 186, "C<sub>6v</sub>"), (187, 190, "D<sub>3h</sub>"), (191, 194, "D<sub>6h</sub>"), (195, 199, "T"), (200, 206, "T<sub>h</sub>"), (207, 214, "O"),
    (215, 220, "T<sub>d</sub>"), (221, 230, "O<sub>h</sub>"),
]
# Space group to layer group, right angles; and what other angles change.
LAYER_GROUPS = {
    3: 8, 4: 9, 5: 10, 6: 11, 7: 12, 8: 13, 10: 14, 11: 15, 12: 16, 13: 17, 14: 18, 16: 19, 17: 20, 18: 21, 21: 22, 25: 24, 26: 26, 27: 27, 28: 29, 29: 30, 30: 31, 31: 32, 32: 33,
    35: 34, 38: 35, 39: 36, 47: 37, 49: 38, 50: 39, 51: 41, 53: 42, 54: 43, 55: 44, 57: 45, 59: 46, 65: 47, 67: 48, 75: 49, 81: 50, 83: 51, 85: 52, 89: 53, 90: 54, 99: 55, 100: 56,
    111: 57, 113: 58, 115: 59, 117: 60, 123: 61, 125: 62, 127: 63, 129: 64, 143: 65, 147: 66, 149: 67, 150: 68, 156: 69, 157: 70, 162: 71, 164: 72, 168: 73, 174: 74, 175: 75,
    177: 76, 183: 77, 187: 78, 189: 79, 191: 80,
}
OBLIQUE_LAYER_GROUPS = {1: 1, 2: 2, 3: 3, 6: 4, 7: 5, 10: 6, 13: 7}
LAYER_SYSTEMS = [(1, 7, "2d-oblique"), (8, 48, "2d-rectangular"), (49, 64, "2d-square"), (65, 80, "2d-hexagonal")]

# Names of enumerated facets, from code 0 on (None: no such code).
ENUMS = {
    3: ["unknown", "unary", "binary", "ternary", "quaternary", "quinary", "senary", "septenary", "octary", "nonary", "decenary", "11-ary", "12-ary", "13-ary", "14-ary", "15-ary"],
    5: ["unknown", "1d", "2d", "3d", "0d", "isolated atom"],
    6: ["unknown properties", "total energy", "electron structure", "geometry optimization", "charges", "magnetic moments", "phonons", "phonon dispersion", "static dielectric constant", "elastic properties"],
    8: [None, "organic molecule", "vacancy defect", "adsorption", "perovskite"],
    15: ["unknown", "non-magnetic", "magnetic"],
    22: ["unknown code", "WIEN2K", "VASP", "CRYSTAL", "Quantum ESPRESSO"],
    26: ["unknown conductivity", "insulator", "conductor"],
    28: ["unknown band gap", "no band gap", "direct", "indirect"],
    75: ["unknown potential", "LDA", "GGA", "meta-GGA", "hybrid", "Hartree-Fock", "DFT+U", "vdW", "MP", "CC", "CI", "GW"],
    80: ["unknown basis set", "LAPW", "plane waves", "gaussians", "numeric AOs"],
    106: ["ab initio calculation", "journal article"],
    1006: ["unknown finalization", "not finalized", "finalized"],
}

# Facets (those that the operators here fill): id, name, source, sort, multiple, optional, summary, column, facet, topic.
FACETS = [
    (1, "formula", "standard", 20, False, False, True, True, True, True), (2, "host elements", "elements", 30, True, False, False, False, True, True),
    (3, "number of elements", "nelem", 40, False, False, True, False, True, True), (5, "periodicity", "periodicity", 50, False, False, True, True, True, True),
    (6, "properties", "calctypes", 60, True, False, True, False, True, True), (8, "features", "tags", 65, True, True, True, False, True, True),
    (22, "modeling code", "framework", 320, False, False, True, True, True, True), (26, "conductivity", "etype", 280, False, False, True, True, True, True),
    (27, "min. band gap", "bandgap", 290, False, False, True, True, True, False), (28, "band gap type", "bandgaptype", 300, False, False, True, False, False, True),
    (75, "main DFT type", "H_types", 200, True, False, True, False, True, True), (80, "basis set", "ansatz", 185, False, False, False, True, True, True),
    (1002, "total energy", "energy", 310, False, False, True, True, False, False), (1003, "cell volume", "dims", 10, False, False, True, True, False, False),
    (1005, "source file", "location", 380, False, False, False, True, False, False), (1006, "finished", "finished", 370, False, False, True, True, False, True),
]
FACET_SCHEMA = "cid int, name string, source string, sort int, multiple boolean, optional boolean, has_summary boolean, has_column boolean, has_facet boolean, has_topic boolean"


def facets(spark):
    """The facet definitions; adding a facet is adding a row."""
    return spark.createDataFrame(FACETS, FACET_SCHEMA)


def enum_values(spark):
    """(cid, num, value) of all enumerations."""
    return spark.createDataFrame([(c, i, v) for c, names in ENUMS.items() for i, v in enumerate(names) if v], "cid int, num int, value string")


def elements(spark):
    """(number, symbol, mass, radius, place) of the elements."""
    place = {s: i for i, s in enumerate(FORMULA_ORDER)}
    return spark.createDataFrame([(i + 1, s, MASSES[i], RADII[i], place.get(s, 999)) for i, s in enumerate(SYMBOLS)], "number int, symbol string, mass double, radius double, place int")
