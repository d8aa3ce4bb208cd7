"""Constants and settings of the retrieval benchmark."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

# Marker genes of each lineage, in lineage order.
MARKER_SETS: dict[str, list[str]] = {
    "B_cell": ["MS4A1", "CD79A", "CD79B", "CD19", "BANK1", "TCL1A"],
    "T_cell": ["CD3D", "CD3E", "CD3G", "TRAC", "CD247", "IL7R", "CD8A", "CD8B"],
    "Myeloid": ["LYZ", "CD68", "C1QA", "C1QC", "CD163", "ITGAX", "TYROBP", "AIF1", "CD14", "FCGR3A"],
    "Endothelial": ["PECAM1", "VWF", "KDR", "CLDN5", "CLEC14A", "EGFL7", "RAMP2", "MMRN2", "AQP1", "CD93"],
    "Fibroblast": ["LUM", "PDGFRA", "PDGFRB", "POSTN", "SFRP4", "FBLN1", "MMP2", "PCOLCE", "DPT", "CCDC80", "LRRC15"],
    "Epithelial": ["EPCAM", "KRT8", "KRT7", "CDH1", "ELF3", "TACSTD2", "KRT5", "KRT14", "KRT15", "CLDN4", "S100A14", "FOXA1", "GATA3"],
    "Mast": ["TPSAB1", "CPA3", "KIT", "CTSG", "HDC"],
}
# Genes of the proliferation state.
PROLIFERATION = ["MKI67", "TOP2A", "CENPF", "PCLAF"]
LINEAGES = list(MARKER_SETS)
UNKNOWN = "unknown"

# The query set, (text, field, label, task, split).
QUERY_SET = [
    ("B cells", "cell_type", "B_cell", "cell_type", "seen"),
    ("T cells", "cell_type", "T_cell", "cell_type", "seen"),
    ("macrophage-rich areas", "cell_type", "Myeloid", "cell_type", "seen"),
    ("endothelial cells", "cell_type", "Endothelial", "cell_type", "seen"),
    ("fibroblasts", "cell_type", "Fibroblast", "cell_type", "seen"),
    ("tumor epithelial cells", "cell_type", "Epithelial", "cell_type", "seen"),
    ("mast cells", "cell_type", "Mast", "cell_type", "seen"),
    ("regions containing B cells", "cell_type", "B_cell", "cell_type", "paraphrase"),
    ("areas with T lymphocytes", "cell_type", "T_cell", "cell_type", "paraphrase"),
    ("myeloid immune cells", "cell_type", "Myeloid", "cell_type", "paraphrase"),
    ("blood vessel lining cells", "cell_type", "Endothelial", "cell_type", "paraphrase"),
    ("stromal fibroblast cells", "cell_type", "Fibroblast", "cell_type", "paraphrase"),
    ("carcinoma epithelial cells", "cell_type", "Epithelial", "cell_type", "paraphrase"),
    ("CD79A positive B cell areas", "gene", "CD79A", "gene_marker", "seen"),
    ("CD3D positive T cell regions", "gene", "CD3D", "gene_marker", "seen"),
    ("CD68 positive macrophage regions", "gene", "CD68", "gene_marker", "seen"),
    ("MKI67 positive regions", "gene", "MKI67", "gene_marker", "seen"),
    ("EPCAM positive epithelial regions", "gene", "EPCAM", "gene_marker", "seen"),
    ("proliferating cells", "cell_state", "proliferating", "cell_state", "seen"),
    ("dividing tumor cells", "cell_state", "proliferating", "cell_state", "paraphrase"),
    ("B cell rich niche", "niche", "bcell_rich", "niche", "seen"),
    ("T cell rich region", "niche", "tcell_rich", "niche", "seen"),
    ("myeloid rich region", "niche", "myeloid_rich", "niche", "seen"),
    ("vascular niche", "niche", "vascular", "niche", "seen"),
    ("immune rich region", "niche", "immune_rich", "niche", "seen"),
    ("tumor immune interface", "niche", "tumor_immune_interface", "niche", "seen"),
    ("region densely populated by B cells", "niche", "bcell_rich", "niche", "paraphrase"),
    ("T cell enriched neighborhood", "niche", "tcell_rich", "niche", "paraphrase"),
    ("perivascular region", "niche", "vascular", "niche", "paraphrase"),
    ("tumor immune boundary", "niche", "tumor_immune_interface", "niche", "paraphrase"),
    ("antibody producing immune cells", "cell_type", "B_cell", "cell_type", "unseen_concept"),
    ("cytotoxic lymphocytes", "cell_type", "T_cell", "cell_type", "unseen_concept"),
    ("keratin expressing cells", "cell_type", "Epithelial", "cell_type", "unseen_concept"),
    ("phagocytic immune cells", "cell_type", "Myeloid", "cell_type", "unseen_concept"),
]
# Prompt templates of the text ensemble.
PROMPTS = [
    "{}",
    "an H&E image of {}",
    "a histopathology image showing {}",
    "a pathology slide with {}",
    "hematoxylin and eosin stain of {}",
    "a microscopy image of {} in breast tissue",
]
# Niches in order of priority for the single label.
NICHES = ["tumor_immune_interface", "vascular", "bcell_rich", "myeloid_rich", "tcell_rich", "immune_rich"]

# Display order and names of methods in the significance table.
METHODS = {
    "random": "Random",
    "biomedclip": "BiomedCLIP zero-shot",
    "plip": "PLIP zero-shot",
    "biomedclip_prompt": "BiomedCLIP zero-shot+prompts",
    "plip_prompt": "PLIP zero-shot+prompts",
    "biomedclip_nbhd": "BiomedCLIP (nbhd)",
    "neighborhood": "Neighborhood-aware",
    "linear_probe": "Linear probe",
    "cellseek_mlp": "Fused features (MLP head)",
    "predexpr": "Predicted-expression",
    "cellseek": "Fused features (ours)",
    "oracle": "Transcriptomic oracle",
}
REFERENCE_METHOD = "cellseek"
# Methods that use images, encoders, scales, reported metrics and cut-offs.
IMAGE_VARIANTS = ["biomedclip", "biomedclip_nbhd", "plip", "neighborhood", "linear_probe", "cellseek_mlp", "cellseek"]
ENCODERS = ["biomedclip", "plip", "uni2", "gigapath", "conch"]
SCALES = ["medium", "neighborhood"]
REPORTED = ["hit@1", "P@5", "R@5", "R@10", "mAP", "MRR", "nDCG@10", "enrich@10"]
KS = [1, 5, 10, 20, 50]


def variant_specs() -> dict[str, list[str]]:
    """Feature variants by name.  Blocks are '<encoder>_<scale>' or the neighbour average of the medium one."""

    def three(encoder: str) -> list[str]:
        return [f"{encoder}_medium", f"{encoder}_neighborhood", f"{encoder}_medium_nbravg"]

    def with_small(encoder: str) -> list[str]:
        return [f"{encoder}_small", *three(encoder)]

    open_ = three("biomedclip") + three("plip")
    every = open_ + three("uni2")
    return {
        "bmc_medium": ["biomedclip_medium"],
        "bmc_multiscale": ["biomedclip_medium", "biomedclip_neighborhood"],
        "bmc_full": three("biomedclip"),
        "plip_full": three("plip"),
        "both_no_context": [f"{e}_{s}" for e in ("biomedclip", "plip") for s in SCALES],
        "cellseek_full": open_,
        "uni2_full": three("uni2"),
        "cellseek_all": every,
        "cellseek_3scale": with_small("biomedclip") + with_small("plip") + with_small("uni2"),
        "gigapath_full": three("gigapath"),
        "conch_full": three("conch"),
        "cellseek_all_conch": every + three("conch"),
        "cellseek_all4": every + three("gigapath"),
    }


@dataclass(frozen=True)
class Settings:
    """Parameters of a run; the defaults, fixed values, are those of the breast sample."""

    min_counts: float = 10
    min_area: float = 0.0
    target_sum: float | None = None
    type_threshold: float = 0.0
    type_margin: float = 0.10
    proliferation_quantile: float = 0.90
    k: int = 15
    radius: float = 50.0
    use: str = "knn"
    niche: dict[str, float] = field(
        default_factory=lambda: {"bcell_rich": 0.15, "tcell_rich": 0.15, "myeloid_rich": 0.15, "vascular": 0.08, "interface_epi": 0.25, "interface_imm": 0.15, "immune_rich": 0.30}
    )
    pool_size: int = 20_000
    stratify: bool = True
    gene_quantile: float = 0.90
    ks: tuple[int, ...] = (1, 5, 10, 20, 50)
    ndcg_k: int = 10
    seed: int = 0
    dataset: str = "dataset"
    sample: str = "sample"
    processed_dir: str = "data/processed"
    results_dir: str = "results"


def load_settings(path: str | None = None, text: str | None = None) -> Settings:
    """Settings from a nested YAML file; sections are flattened onto the fields they mean."""
    if path is None and text is None:
        return Settings()
    import yaml

    raw: dict[str, Any] = yaml.safe_load(Path(path).read_text() if path else text) or {}
    pre, near, pool, ret, data = (raw.get(s, {}) or {} for s in ("preprocess", "neighborhood", "candidate_pool", "retrieval", "dataset"))
    th = near.get("niche_thresholds", {}) or {}
    niche = Settings().niche | {k: th[v] for k, v in {"bcell_rich": "bcell_rich", "tcell_rich": "tcell_rich", "myeloid_rich": "myeloid_rich", "vascular": "vascular", "interface_epi": "tumor_immune_interface_epi", "interface_imm": "tumor_immune_interface_imm"}.items() if v in th}
    given = {
        "min_counts": pre.get("min_transcript_counts"),
        "min_area": pre.get("min_cell_area"),
        "target_sum": pre.get("normalize_target_sum"),
        "type_threshold": pre.get("celltype_score_threshold"),
        "type_margin": pre.get("celltype_margin"),
        "proliferation_quantile": pre.get("proliferation_quantile"),
        "k": near.get("k"),
        "radius": near.get("radius_um"),
        "use": near.get("use"),
        "pool_size": pool.get("size"),
        "stratify": pool.get("stratify"),
        "ks": tuple(ret["topk"]) if "topk" in ret else None,
        "ndcg_k": ret.get("ndcg_k"),
        "seed": raw.get("seed"),
        "dataset": data.get("name"),
        "sample": data.get("sample"),
        "processed_dir": data.get("processed_dir"),
        "results_dir": data.get("results_dir"),
    }
    known = {f.name for f in fields(Settings)}
    return Settings(**{k: v for k, v in given.items() if v is not None and k in known}, niche=niche)


def results_dir(settings: Settings, part: str = "") -> str:
    """Where a part of the results goes, absolute."""
    return str((Path(settings.results_dir) / part).absolute())
