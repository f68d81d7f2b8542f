"""Families, their settings and the catalogue of datasets."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from scalefold.operators import grids
from scalefold.session import local_table


@dataclass(frozen=True)
class Family:
    """Settings shared by the datasets of one family."""

    name: str
    subset_size: int
    n_subsets: int
    expected_df: float
    sigma_df: float
    denoise: str
    scales: list[int] = field(default_factory=list)  # empty: grid by series length
    min_std: float = 1e-5
    fs: float = 1.0
    tci_min_len: int = 0


# Settings per family.
FAMILIES = [
    Family("strain", 4 * 16384, 100, 1.22, 0.05, "strain", grids.log_scales(*grids.STRAIN_GRID), fs=16384.0),
    Family("sky_map", 100_000, 100, 1.19, 0.04, "unit_std", [2, 4, 8, 16, 32, 64, 128]),
    Family("sky_map_survey", 45_000, 250, 1.19, 0.04, "unit_std", [2, 4, 8, 16, 32, 64, 128]),
    Family("catalog", 3_700, 100, 1.19, 0.04, "unit_std", [2, 4, 8, 16, 32, 64, 128]),
    Family("collision", 5_000, 100, 1.19, 0.04, "unit_std", [2, 4, 8, 16, 32, 64, 128]),
    Family("lines", 125, 100, 1.16, 0.04, "lines", tci_min_len=10),
    Family("pulsar", 250, 100, 1.19, 0.04, "pulsar", [2, 4, 8, 16, 32, 64, 128, 256], tci_min_len=500),
    Family("bits", 2_560, 100, 1.21, 0.04, "z_score", [2, 4, 8, 16, 32, 64, 128, 256, 512, 1024]),
    Family("astrometry", 7_500, 100, 1.19, 0.04, "unit_std", [1, 2, 4, 6, 8, 16, 32, 64]),
]

# Column names and positions per family.
CATALOG_COLUMNS = ["FLUX_Z", "FLUX_G", "FLUX_R"]
COLLISION_COLUMNS = ["lep_pt", "lep_eta", "lep_phi"]
LINES_COLUMNS = ["intens", "wn(cm-1)", "Aki(10^8 s^-1)", "obs_wl_vac(nm)"]
PULSAR_CHANNELS = ["residuals", "dmx", "red_noise"]
ASTROMETRY_COLUMNS = {"RA_ICRS": 1, "DE_ICRS": 2, "pmRA": 12, "pmDE": 14, "Gmag": 54}
ASTROMETRY_SKIP = 257
ASTROMETRY_ROWS = 2 * 7_500
DISC_RADIUS = {"sky_map": math.radians(20), "sky_map_survey": math.radians(30)}
PULSAR_DATE = "20220302"
PULSAR_DATES = {"J1713+0747": "20220309"}

# Chemical symbols with a spectral-line file, and their names.
ELEMENTS = {
    "Ac": "Actinium", "Ag": "Silver", "Al": "Aluminium", "Ar": "Argon", "B": "Boron",
    "Ba": "Barium", "Be": "Beryllium", "Bi": "Bismuth", "Br": "Bromine", "C": "Carbon",
    "Ca": "Calcium", "Cd": "Cadmium", "Ce": "Cerium", "Cl": "Chlorine", "Co": "Cobalt",
    "Cr": "Chromium", "Cs": "Cesium", "Cu": "Copper", "Dy": "Dysprosium", "Eu": "Europium",
    "F": "Fluorine", "Fe": "Iron", "H": "Hydrogen", "He": "Helium", "Hf": "Hafnium",
    "Hg": "Mercury", "I": "Iodine", "In": "Indium", "Ir": "Iridium", "K": "Potassium",
    "Kr": "Krypton", "La": "Lanthanum", "Li": "Lithium", "Mg": "Magnesium", "Mn": "Manganese",
    "Mo": "Molybdenum", "N": "Nitrogen", "Na": "Sodium", "Nb": "Niobium", "Nd": "Neodymium",
    "Ne": "Neon", "Ni": "Nickel", "O": "Oxygen", "Os": "Osmium", "P": "Phosphorus",
    "Pr": "Praseodymium", "Pt": "Platinum", "Rb": "Rubidium", "Re": "Rhenium", "Rh": "Rhodium",
    "S": "Sulfur", "Sc": "Scandium", "Si": "Silicon", "Sn": "Tin", "Sr": "Strontium",
    "Ta": "Tantalum", "Ti": "Titanium", "Tm": "Thulium", "V": "Vanadium", "W": "Tungsten",
    "Xe": "Xenon", "Y": "Yttrium", "Zr": "Zirconium",
}

# Pulsars with timing data, and those measured by default.
PULSARS = """
    J0030+0451 J0340+4130 J0406+3039 J0437-4715 J0509+0856 J0557+1551 J0605+3757 J0610-2100 J0613-0200 J0614-3329
    J0636+5128 J0645+5158 J0709+0458 J0740+6620 J0931-1902 J1012+5307 J1012-4235 J1022+1001 J1024-0719 J1125+7819
    J1312+0051 J1453+1902 J1455-3330 J1600-3053 J1614-2230 J1630+3734 J1640+2224 J1643-1224 J1705-1903 J1713+0747
    J1719-1438 J1730-2304 J1738+0333 J1741+1351 J1744-1134 J1745+1017 J1747-4036 J1802-2124 J1811-2405 J1832-0836
    J1843-1113 J1853+1303 J1903+0327 J1909-3744 J1910+1256 J1911+1347 J1918-0642 J1923+2515 J1944+0907 J1946+3417
    J2010-1323 J2017+0603 J2022+2534 J2033+1734 J2043+1711 J2124-3358 J2214+3000 J2229+2643 J2234+0611 J2234+0944
    J2302+4442 J2317+1439 J2322+2057 B1855+09 B1937+21 B1953+29 J0751+1807 J0023+0923 J1751-2857 J0125-2327
    J0732+2314 J1221-0633 J1400-1431 J1630+3550 J2039-3616 J0218+4232 J0337+1715 J0621+2514 J0721-2038 J1803+1358
    B1257+12 J1327+3423 J0154+1833
""".split()
PULSARS_ENABLED = """
    J0030+0451 J0340+4130 J0406+3039 J0437-4715 J0509+0856 J1719-1438 J1730-2304 J0610-2100 J0613-0200 J0614-3329
    J0636+5128 J0645+5158 J0709+0458 J0740+6620 J0931-1902 J1012+5307 J1012-4235 J1022+1001 J1024-0719 J1125+7819
    J1312+0051 J1453+1902 J1455-3330 J1600-3053 J1614-2230 J1630+3734 J1640+2224 J1643-1224 J1705-1903 J1713+0747
""".split()

# Names of the other datasets and whether they are measured by default.
OTHERS = [
    ("strain", "LIGO-L1_1368350720", True),
    ("strain", "LIGO-L1_1384779776(GW231123)", False),
    ("strain", "LIGO-L1_1370202112", False),
    ("strain", "LIGO-L1_1389420544", False),
    ("sky_map", "Planck_CMB_I-Stokes_nosz", False),
    ("sky_map", "Planck_CMB_I-Stokes", False),
    ("sky_map_survey", "Planck_LFI_70GHz", False),
    ("catalog", "DESI_LRG", False),
    ("collision", "CERN_2Lepton", False),
    ("bits", "QRNG", True),
    ("astrometry", "Gaia_DR3", False),
]

FAMILY_SCHEMA = (
    "name string, subset_size int, n_subsets int, expected_df double, sigma_df double, denoise string, "
    "scales array<int>, min_std double, fs double, tci_min_len int"
)


def family_config(spark: SparkSession, families: list[Family] = FAMILIES) -> DataFrame:
    rows = [tuple(asdict(f).values()) for f in families]
    return local_table(spark, rows, FAMILY_SCHEMA).withColumnRenamed("name", "family")


def dataset_catalog(spark: SparkSession) -> DataFrame:
    """S10. One row per dataset: name, family and whether it is measured."""
    rows = [(name, family, on) for family, name, on in OTHERS]
    rows += [(f"NIST_3_{e}_{name}", "lines", True) for e, name in ELEMENTS.items()]
    rows += [(p, "pulsar", p in PULSARS_ENABLED) for p in PULSARS]
    return local_table(spark, rows, "series_id string, family string, enabled boolean")


def dataset_config(spark: SparkSession, families: list[Family] = FAMILIES) -> DataFrame:
    return dataset_catalog(spark).join(family_config(spark, families), "family")
