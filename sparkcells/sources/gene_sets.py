"""Gene sets: tables (category, gene)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Published cell-cycle signatures.
S_PHASE = [
    "MCM5", "PCNA", "TYMS", "FEN1", "MCM2", "MCM4", "RRM1", "UNG", "GINS2", "MCM6", "CDCA7", "DTL", "PRIM1", "UHRF1", "MLF1IP", "HELLS", "RFC2",
    "RPA2", "NASP", "RAD51AP1", "GMNN", "WDR76", "SLBP", "CCNE2", "UBR7", "POLD3", "MSH2", "ATAD2", "RAD51", "RRM2", "CDC45", "CDC6", "EXO1", "TIPIN",
    "DSCC1", "BLM", "CASP8AP2", "USP1", "CLSPN", "POLA1", "CHAF1B", "BRIP1", "E2F8",
]
G2M_PHASE = [
    "HMGB2", "CDK1", "NUSAP1", "UBE2C", "BIRC5", "TPX2", "TOP2A", "NDC80", "CKS2", "NUF2", "CKS1B", "MKI67", "TMPO", "CENPF", "TACC3", "FAM64A",
    "SMC4", "CCNB2", "CKAP2L", "CKAP2", "AURKB", "BUB1", "KIF11", "ANP32E", "TUBB4B", "GTSE1", "KIF20B", "HJURP", "HJURP", "CDCA3", "HN1", "CDC20",
    "TTK", "CDC25C", "KIF2C", "RANGAP1", "NCAPD2", "DLGAP5", "CDCA2", "CDCA8", "ECT2", "KIF23", "HMMR", "AURKA", "PSRC1", "ANLN", "LBR", "CKAP5",
    "CENPE", "CTCF", "NEK2", "G2E3", "GAS2L3", "CBX5", "CENPA",
]
# Published B cell markers.
B_CELLS = {
    "B_follicular": ["SUGCT", "AICDA", "MYBL1", "SPRED2", "CAMK1", "PDGFD", "ASB13", "SERPINA9", "CDCA7", "RGS13"],
    "B_memory": ["CD70", "RP5-887A10.1", "CLECL1", "AHNAK", "MARCKS", "SAMSN1", "METTL8", "GPR183", "C1orf132", "CAPG"],
    "B_naive": ["COL19A1", "KLF4", "LAIR1", "CLEC2B", "IGHD", "DNASE1L3", "CHI3L2", "FCER2", "BTLA", "TMEM2"],
    "B_plasma": ["SDC1", "GAS6", "CAV1", "RP11-290F5.1", "JSRP1", "CCR10", "ABCB9", "IGHGP", "PRDM1", "TXNDC5"],
}

SIGNATURES = {"cc_genes_s": S_PHASE, "cc_genes_m": G2M_PHASE} | B_CELLS


def bundled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, gene) for name, genes in SIGNATURES.items() for gene in genes], "category string, gene string")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines file of category and genes, as a table (category, gene)."""
    from pyspark.sql import functions as F

    return spark.read.schema("category string, genes array<string>").json(path).select("category", F.explode("genes").alias("gene"))
