"""Element data. Fixed values throughout; elements that a table lacks count as 0."""

from __future__ import annotations

# Symbols in the order of their atomic numbers, and properties by atomic number.
SYMBOLS = (
    "H", "He", "Li", "Be", "B", "C", "N", "O", "F", "Ne",
    "Na", "Mg", "Al", "Si", "P", "S", "Cl", "Ar", "K", "Ca",
    "Sc", "Ti", "V", "Cr", "Mn", "Fe", "Co", "Ni", "Cu", "Zn",
    "Ga", "Ge", "As", "Se", "Br", "Kr", "Rb", "Sr", "Y", "Zr",
    "Nb", "Mo", "Tc", "Ru", "Rh", "Pd", "Ag", "Cd", "In", "Sn",
)
ATOMIC_NUMBER = {s: z for z, s in enumerate(SYMBOLS, 1)}

#: kg
MASS = {
    1: 1.6735e-27, 2: 6.6465e-27, 3: 1.1526e-26, 4: 1.4966e-26, 5: 1.796e-26, 6: 1.9944e-26, 7: 2.3259e-26, 8: 2.656e-26, 9: 3.1548e-26, 10: 3.3509e-26,
    11: 3.8175e-26, 12: 4.0438e-26, 13: 4.4804e-26, 14: 4.6637e-26, 15: 5.1441e-26, 16: 5.3126e-26, 17: 5.887e-26, 18: 6.6335e-26, 19: 6.4924e-26, 20: 6.656e-26,
    21: 7.946e-26, 22: 7.946e-26, 23: 8.493e-26, 24: 8.634e-26, 25: 9.127e-26, 26: 9.288e-26, 27: 9.787e-26, 28: 9.744e-26, 29: 1.055e-25, 30: 1.088e-25,
    31: 1.151e-25, 32: 1.206e-25, 33: 1.244e-25, 34: 1.31e-25, 35: 1.328e-25, 36: 1.392e-25, 37: 1.419e-25, 38: 1.487e-25, 39: 1.51e-25, 40: 1.644e-25,
    41: 1.745e-25, 42: 1.593e-25, 43: 1.811e-25, 44: 1.774e-25, 45: 1.867e-25, 46: 1.77e-25, 47: 1.791e-25, 48: 1.865e-25, 49: 2.1e-25, 50: 1.97e-25,
}
PAULING = {
    1: 2.2, 3: 0.98, 4: 1.57, 5: 2.04, 6: 2.55, 7: 3.04, 8: 3.44, 9: 3.98, 11: 0.93, 12: 1.31,
    13: 1.61, 14: 1.9, 15: 2.19, 16: 2.58, 17: 3.16, 19: 0.82, 20: 1.0, 21: 1.36, 22: 1.54, 23: 1.63,
    24: 1.66, 25: 1.55, 26: 1.83, 27: 1.88, 28: 1.91, 29: 1.9, 30: 1.65, 31: 1.81, 32: 2.01, 33: 2.18,
    34: 2.55, 35: 2.96, 37: 0.82, 38: 0.95, 39: 1.22, 40: 1.33, 41: 1.6, 42: 2.16, 43: 1.9, 44: 2.2,
    45: 2.28, 46: 2.2, 47: 1.93, 48: 1.69, 49: 1.78, 50: 1.96,
}
ALLRED_ROCHOW = {
    1: 2.2, 3: 0.97, 4: 1.47, 5: 2.01, 6: 2.5, 7: 3.07, 8: 3.5, 9: 4.1, 11: 1.01, 12: 1.23,
    13: 1.47, 14: 1.74, 15: 2.06, 16: 2.44, 17: 2.83, 19: 0.91, 20: 1.0, 21: 1.36, 22: 1.32, 23: 1.45,
    24: 1.56, 25: 1.6, 26: 1.64, 27: 1.7, 28: 1.75, 29: 1.75, 30: 1.65, 31: 1.81, 32: 2.02, 33: 2.2,
    34: 2.48, 35: 2.74, 37: 0.89, 38: 0.96, 39: 1.22, 40: 1.32, 41: 1.6, 42: 2.16, 43: 1.9, 44: 2.2,
    45: 2.28, 46: 2.2, 47: 1.93, 48: 1.69, 49: 1.78, 50: 1.96,
}
#: J
IONIZATION = {
    1: 2.179e-18, 2: 3.94e-18, 3: 5.39e-19, 4: 9.32e-19, 5: 8.3e-19, 6: 1.805e-18, 7: 2.327e-18, 8: 2.183e-18, 9: 2.791e-18, 10: 3.09e-18,
    11: 8.236e-19, 12: 1.226e-18, 13: 9.8e-19, 14: 1.079e-18, 15: 1.681e-18, 16: 1.661e-18, 17: 2.078e-18, 18: 2.273e-18, 19: 6.98e-19, 20: 9.796e-19,
    21: 6.56e-19, 22: 6.82e-19, 23: 6.74e-19, 24: 6.77e-19, 25: 7.43e-19, 26: 7.9e-19, 27: 7.86e-19, 28: 7.64e-19, 29: 7.73e-19, 30: 9.39e-19,
    31: 6e-19, 32: 7.9e-19, 33: 9.81e-19, 34: 9.75e-19, 35: 1.18e-18, 36: 1.35e-18, 37: 4.18e-19, 38: 5.7e-19, 39: 6.17e-19, 40: 6.33e-19,
    41: 6.76e-19, 42: 6.88e-19, 43: 7.28e-19, 44: 7.36e-19, 45: 7.46e-19, 46: 8.34e-19, 47: 7.58e-19, 48: 8.99e-19, 49: 5.79e-19, 50: 7.34e-19,
}
#: J
AFFINITY = {
    1: 1.209e-19, 3: 6.47e-20, 5: 5.84e-20, 6: 2.024e-19, 7: -1.12e-20, 8: 2.341e-19, 9: 5.451e-19, 11: 8.78e-20, 12: 0.0, 13: 7.08e-20,
    14: 2.23e-19, 15: 1.197e-19, 16: 2.077e-19, 17: 3.612e-19, 19: 8.03e-20, 20: 2.39e-20, 21: 1.92e-20, 22: 3.69e-20, 23: 5.15e-20, 24: 6.46e-20,
    25: 1.24e-19, 26: 2.42e-20, 27: 6.3e-20, 28: 1.15e-19, 29: 1.24e-19, 30: 0.0, 31: 3.02e-20, 32: 1.2e-19, 33: 7.77e-20, 34: 2.02e-19,
    35: 3.365e-19, 37: 4e-20, 38: 4.4e-20, 39: 3.5e-20, 40: 4.15e-20, 41: 8.91e-20, 42: 7.38e-20, 43: 5.49e-20, 44: 1.05e-19, 45: 1.1e-19,
    46: 5.6e-20, 47: 1.3e-19, 48: 0.0, 49: 3e-20, 50: 1.17e-19,
}
#: m
COVALENT_RADIUS = {
    1: 3.1e-11, 3: 1.28e-10, 4: 9.6e-11, 5: 8.4e-11, 6: 7.6e-11, 7: 7.1e-11, 8: 6.6e-11, 9: 5.7e-11, 11: 1.66e-10, 12: 1.41e-10,
    13: 1.21e-10, 14: 1.11e-10, 15: 1.07e-10, 16: 1.05e-10, 17: 1.02e-10, 19: 2.03e-10, 20: 1.76e-10, 21: 1.7e-10, 22: 1.6e-10, 23: 1.53e-10,
    24: 1.39e-10, 25: 1.39e-10, 26: 1.32e-10, 27: 1.26e-10, 28: 1.24e-10, 29: 1.32e-10, 30: 1.22e-10, 31: 1.22e-10, 32: 1.2e-10, 33: 1.19e-10,
    34: 1.2e-10, 35: 1.2e-10, 37: 2.2e-10, 38: 1.95e-10, 39: 1.8e-10, 40: 1.75e-10, 41: 1.64e-10, 42: 1.54e-10, 43: 1.47e-10, 44: 1.46e-10,
    45: 1.42e-10, 46: 1.39e-10, 47: 1.45e-10, 48: 1.44e-10, 49: 1.42e-10, 50: 1.39e-10,
}
#: m
VDW_RADIUS = {
    1: 1.2e-10, 2: 1.4e-10, 3: 1.82e-10, 6: 1.7e-10, 7: 1.55e-10, 8: 1.52e-10, 9: 1.47e-10, 10: 1.54e-10, 11: 2.27e-10, 12: 1.73e-10,
    13: 1.84e-10, 14: 2.1e-10, 15: 1.8e-10, 16: 1.8e-10, 17: 1.75e-10, 18: 1.88e-10, 19: 2.75e-10, 20: 2.31e-10, 21: 2.11e-10, 22: 2e-10,
    23: 2e-10, 24: 2e-10, 25: 2e-10, 26: 1.94e-10, 27: 2e-10, 28: 1.63e-10, 29: 1.4e-10, 30: 1.39e-10, 31: 1.87e-10, 32: 2.11e-10,
    33: 1.85e-10, 34: 1.9e-10, 35: 1.85e-10, 36: 2.02e-10, 37: 2.98e-10, 38: 2.49e-10, 39: 2.27e-10, 40: 2.16e-10, 41: 2.08e-10, 42: 2.01e-10,
    43: 2e-10, 44: 2e-10, 45: 2e-10, 46: 1.63e-10, 47: 1.72e-10, 48: 1.58e-10, 49: 1.93e-10, 50: 2.17e-10,
}
#: Cubic angstrom
POLARIZABILITY = {
    1: 0.666, 2: 0.204, 3: 24.3, 4: 5.6, 5: 3.03, 6: 1.76, 7: 1.1, 8: 0.802, 9: 0.557, 10: 0.395,
    11: 24.11, 12: 10.6, 13: 6.8, 14: 5.38, 15: 7.43, 16: 2.9, 17: 2.18, 18: 1.64, 19: 43.4, 20: 22.8,
    21: 18.1, 22: 10.6, 23: 8.4, 24: 6.2, 25: 7.4, 26: 7.0, 27: 6.4, 28: 6.2, 29: 6.4, 30: 6.2,
    31: 7.7, 32: 6.1, 33: 4.4, 34: 3.8, 35: 3.05, 36: 2.48, 37: 47.3, 38: 28.9, 39: 11.6, 40: 9.5,
    41: 7.3, 42: 5.7, 43: 5.3, 44: 5.3, 45: 6.1, 46: 6.1, 47: 7.2, 48: 7.1, 49: 8.4, 50: 7.4,
}
#: kg/m3
DENSITY = {
    1: 0.08988, 2: 0.1786, 3: 534.0, 4: 1848.0, 5: 2460.0, 6: 2267.0, 7: 1.2506, 8: 1.429, 9: 1.696, 10: 0.9002,
    11: 968.0, 12: 1738.0, 13: 2700.0, 14: 2330.0, 15: 1823.0, 16: 2070.0, 17: 3.2, 18: 1.784, 19: 862.0, 20: 1550.0,
    21: 2989.0, 22: 4507.0, 23: 6110.0, 24: 7190.0, 25: 7470.0, 26: 7874.0, 27: 8900.0, 28: 8908.0, 29: 8960.0, 30: 7140.0,
    31: 5907.0, 32: 5323.0, 33: 5727.0, 34: 4819.0, 35: 3120.0, 36: 3.75, 37: 1532.0, 38: 2630.0, 39: 4472.0, 40: 6511.0,
    41: 8570.0, 42: 10280.0, 43: 11500.0, 44: 12370.0, 45: 12410.0, 46: 12020.0, 47: 10490.0, 48: 8650.0, 49: 7310.0, 50: 7287.0,
}
#: W/(m K)
THERMAL_CONDUCTIVITY = {
    1: 0.1815, 2: 0.1513, 3: 84.7, 4: 200.0, 5: 27.0, 6: 140.0, 7: 0.026, 8: 0.0266, 9: 0.0277, 10: 0.0491,
    11: 142.0, 12: 156.0, 13: 235.0, 14: 148.0, 15: 0.236, 16: 0.269, 17: 0.0098, 18: 0.0177, 19: 102.0, 20: 201.0,
    21: 15.8, 22: 21.9, 23: 30.7, 24: 93.7, 25: 7.8, 26: 80.4, 27: 100.0, 28: 90.9, 29: 401.0, 30: 116.0,
    31: 29.0, 32: 60.2, 33: 50.0, 34: 0.52, 35: 0.12, 36: 0.0095, 37: 58.0, 38: 35.0, 39: 17.0, 40: 22.6,
    41: 53.7, 42: 138.0, 43: 50.6, 44: 117.0, 45: 150.0, 46: 71.8, 47: 429.0, 48: 96.6, 49: 81.8, 50: 66.8,
}
#: J/(g K)
SPECIFIC_HEAT = {
    1: 14.304, 2: 5.193, 3: 3.582, 4: 1.825, 5: 1.026, 6: 0.709, 7: 1.04, 8: 0.918, 9: 0.824, 10: 1.03,
    11: 1.228, 12: 1.023, 13: 0.897, 14: 0.705, 15: 0.769, 16: 0.71, 17: 0.479, 18: 0.52, 19: 0.753, 20: 0.647,
    21: 0.568, 22: 0.523, 23: 0.489, 24: 0.449, 25: 0.479, 26: 0.449, 27: 0.421, 28: 0.444, 29: 0.385, 30: 0.388,
    31: 0.371, 32: 0.32, 33: 0.329, 34: 0.321, 35: 0.474, 36: 0.248, 37: 0.363, 38: 0.301, 39: 0.298, 40: 0.278,
    41: 0.265, 42: 0.251, 43: 0.21, 44: 0.238, 45: 0.243, 46: 0.244, 47: 0.235, 48: 0.232, 49: 0.233, 50: 0.228,
}
#: cm3/mol
MOLAR_VOLUME = {
    1: 14.1, 2: 27.2, 3: 13.1, 4: 4.9, 5: 4.6, 6: 5.3, 7: 17.3, 8: 14.0, 9: 17.1, 10: 16.5,
    11: 23.7, 12: 13.97, 13: 10.0, 14: 12.1, 15: 17.0, 16: 15.5, 17: 17.9, 18: 22.4, 19: 45.3, 20: 29.9,
    21: 15.0, 22: 10.6, 23: 8.78, 24: 7.23, 25: 7.39, 26: 7.09, 27: 6.7, 28: 6.59, 29: 7.11, 30: 9.16,
    31: 11.8, 32: 13.6, 33: 13.1, 34: 16.5, 35: 23.5, 36: 38.9, 37: 55.9, 38: 33.4, 39: 19.9, 40: 14.1,
    41: 10.9, 42: 9.4, 43: 8.5, 44: 8.3, 45: 8.2, 46: 8.9, 47: 10.3, 48: 13.1, 49: 15.7, 50: 16.3,
}

#: Elements of the text scales, which also know aromatic lower-case atoms.
TEXT_PAULING = {s: PAULING[z] for s, z in ATOMIC_NUMBER.items() if z in PAULING} | {"Sb": 2.05, "Te": 2.1, "I": 2.66, "c": 2.55, "n": 3.04, "o": 3.44, "p": 2.19, "s": 2.58, "b": 2.04, "i": 2.66}
#: What an aromatic letter stands for.
_AROMATIC = {"c": "C", "n": "N", "o": "O", "p": "P", "s": "S", "b": "B", "i": "I"}


def _with_aromatic(scale: dict[str, float]) -> dict[str, float]:
    return scale | {a: scale[s] for a, s in _AROMATIC.items()}


TEXT_ALLRED = _with_aromatic({"H": 2.2, "C": 2.5, "N": 3.07, "O": 3.5, "F": 4.1, "P": 2.06, "S": 2.44, "Cl": 2.83, "Br": 2.74, "I": 2.21, "B": 2.01, "Si": 1.74, "As": 2.2, "Se": 2.48})
TEXT_MULLIKEN = _with_aromatic({"H": 2.25, "C": 2.63, "N": 3.06, "O": 3.61, "F": 4.43, "P": 2.32, "S": 2.69, "Cl": 3.54, "Br": 3.24, "I": 2.37, "B": 2.05, "Si": 2.03, "As": 2.33, "Se": 2.75})
TEXT_SANDERSON = _with_aromatic({"H": 2.59, "C": 2.75, "N": 3.19, "O": 3.65, "F": 4.0, "P": 2.55, "S": 2.96, "Cl": 3.48, "Br": 3.22, "I": 2.14, "B": 2.28, "Si": 2.14, "As": 2.55, "Se": 2.84})
TEXT_WEIGHT = _with_aromatic({
    "H": 1.008, "Li": 6.941, "Be": 9.012, "B": 10.811, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Na": 22.99, "Mg": 24.305,
    "Al": 26.982, "Si": 28.085, "P": 30.974, "S": 32.065, "Cl": 35.453, "K": 39.098, "Ca": 40.078, "Sc": 44.956, "Ti": 47.867, "V": 50.942,
    "Cr": 51.996, "Mn": 54.938, "Fe": 55.845, "Co": 58.933, "Ni": 58.693, "Cu": 63.546, "Zn": 65.38, "Ga": 69.723, "Ge": 72.64, "As": 74.922,
    "Se": 78.96, "Br": 79.904, "Rb": 85.468, "Sr": 87.62, "Y": 88.906, "Zr": 91.224, "Nb": 92.906, "Mo": 95.94, "Tc": 98.0, "Ru": 101.07,
    "Rh": 102.906, "Pd": 106.42, "Ag": 107.868, "Cd": 112.41, "In": 114.82, "Sn": 118.71, "Sb": 121.76, "Te": 127.6, "I": 126.904,
})
#: Atomic numbers of the elements of the text scales.
TEXT_NUMBER = {s: z for s, z in (ATOMIC_NUMBER | {"Sb": 51, "Te": 52, "I": 53}).items() if s in TEXT_PAULING}
TEXT_NUMBER |= {a: TEXT_NUMBER[s] for a, s in _AROMATIC.items()}

HALOGENS = {9, 17, 35, 53, 85}
NON_METALS = {1, 2, 5, 6, 7, 8, 9, 10, 14, 15, 16, 17, 18, 32, 33, 34, 35, 36, 51, 52, 53, 54}


def period(z: int) -> int:
    """Periodic period, 0 past Z = 50."""
    return 0 if not 1 <= z <= 50 else next(p for p, last in enumerate((2, 10, 18, 36, 54), 1) if z <= last)


def group(z: int) -> int:
    """Periodic group, 0 past Z = 50."""
    p = period(z)
    if not p:
        return 0
    k = z - (0, 2, 10, 18, 36)[p - 1]
    short = p < 4
    if p == 1:
        return 1 if z == 1 else 18
    return k if k <= 2 or not short else k + 10


def is_main_group(z: int) -> bool:
    return group(z) in (1, 2, *range(13, 19))


def is_transition_metal(z: int) -> bool:
    return period(z) >= 4 and 3 <= group(z) <= 12


def is_alkali_metal(z: int) -> bool:
    return group(z) == 1 and z > 2


def is_alkaline_earth(z: int) -> bool:
    return group(z) == 2 and z > 2


def is_noble_gas(z: int) -> bool:
    return group(z) == 18


def is_metal(z: int) -> bool:
    return z > 0 and z not in NON_METALS
