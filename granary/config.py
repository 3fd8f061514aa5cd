"""Parameters of the operators. Every threshold and lexicon is a field, so that another corpus sets its own."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

# The canonical classes.
CANONICAL_CLASSES = ("Bacterial_Leaf_Blight", "Brown_Spot", "Leaf_Blast", "Narrow_Brown", "Rice_Tungro", "Sheath_Blight")

# Patterns of the canonical and the other classes as chunks are labelled (case is ignored).
CHUNK_LEXICON = {
    "Bacterial_Leaf_Blight": r"bacterial (leaf )?blight|\bBLB\b|Xanthomonas oryzae pv\.? oryzae|\bXoo\b|\bBB\b(?!\s+(Table|Figure|Fig))",
    "Brown_Spot": r"brown spot|Bipolaris oryzae|Cochliobolus miyabeanus|Helminthosporium oryzae|\bBSp\b",
    "Leaf_Blast": r"\bleaf blast\b|\bblast\b|Magnaporthe|Pyricularia|\bRBl\b(?!\s+(Table|Figure|Fig))",
    "Narrow_Brown": r"narrow brown( leaf)? spot|\bNBLs?\b|Cercospora janseana|Sphaerulina oryzina",
    "Rice_Tungro": r"tungro|\bRTBV\b|\bRTSV\b|\bRTV\b|\bRTD\b",
    "Sheath_Blight": r"sheath blight|Rhizoctonia solani|\bShB\b",
}
OTHER_LEXICON = {
    "Kernel Smut": r"kernel smut",
    "False Smut": r"false smut",
    "Stem Rot": r"stem rot|Sclerotium oryzae",
    "White Leaf Streak": r"white leaf streak",
    "Bacterial Leaf Streak": r"bacterial leaf streak|\bBLS\b",
    "Grain Discoloration": r"grain discolo",
    "Rice Black-Streaked Dwarf": r"black-?streaked dwarf|\bRBSDV?\b|\bSRBSDV?\b",
}
# Patterns of the coverage statistics, which differ from those of the chunks.
COVERAGE_LEXICON = {
    "Bacterial_Leaf_Blight": r"bacterial (leaf )?blight|\bBLB\b|\bBB\b(?! Table)|Xanthomonas oryzae pv\.? oryzae\b|\bXoo\b",
    "Brown_Spot": r"brown spot|Bipolaris oryzae|Cochliobolus miyabeanus|Helminthosporium oryzae",
    "Leaf_Blast": r"\bleaf blast\b|\bblast\b|Magnaporthe|Pyricularia",
    "Narrow_Brown": r"narrow brown( leaf)? spot|\bNBLS\b|Cercospora janseana|Sphaerulina oryzina",
    "Rice_Tungro": r"tungro|\bRTBV\b|\bRTSV\b",
    "Sheath_Blight": r"sheath blight|Rhizoctonia solani|\bShB\b",
}
COVERAGE_TREATMENT = r"fungicid|chemical control|管理|manage(ment)?\b|control measure|cultural practice|resistant variet|seed treatment|spray|dosage|application rate|integrated"
COVERAGE_INOCULATION = r"inoculat|spore suspension|inoculum|clipping method|greenhouse test|screening"

# Patterns that type a chunk.
MANAGEMENT_HEADING = r"\bmanagement\b|\bcontrol\b|cultural practice|fungicid|chemical|resistant variet|varietal resistance|seed treatment|\btreatment\b"
ACTIONABLE = (
    r"\bfungicid\w*\b|\bapply\b|\bapplication rate\b|\bspray\b|\bseed treatment\b|\bfl oz\b|\bkg/ha\b|\bg/ha\b|\bl/ha\b|\brecommended\b|"
    r"\bresistant cultivars?\b|\bresistant variet\w+\b|\bsusceptible cultivars?\b|\bavoid\b|\bmaintain\b|\bplant early\b|\brotat\w+\b|\bsanitation\b|"
    r"\bdestroy\b|\bremove\b|\bdrain\b|\bflood depth\b|\bfertility program\b"
)
MANAGEMENT_MARKER = r"\bManagement\b\s*[•\-]|\bControl measures?\b|\bDisease management\b"
INOCULATION = r"inoculat|spore suspension|inoculum|clipping method|scissor.?dip|spray.{0,20}suspension|conidial suspension"
SCREENING_TYPE = "screening_manual"

# Split words that are repaired, in this order, and genus names beside which nothing is joined.
WORD_JOINS = (
    ("espe cially", "especially"), ("experi ence", "experience"), ("d uring", "during"), ("h owever", "however"),
    ("d iseases", "diseases"), ("spor es", "spores"), ("telio spores", "teliospores"), ("r outine", "routine"),
)
GUARDED_GENERA = ("Echinochloa", "Oryza", "Magnaporthe", "Pyricularia", "Rhizoctonia", "Bipolaris", "Cercospora", "Xanthomonas", "Sphaerulina", "Cochliobolus", "Sclerotium", "Fusarium")

# Thresholds of the detector's classes, in the order of its class numbers, and the floor.
DETECTION_THRESHOLDS = (0.25, 0.15, 0.15, 0.15, 0.30, 0.30)
DETECTION_FLOOR = 0.15


@dataclass(frozen=True)
class LayoutLimits:
    """Page layout and running lines."""

    thin_page_chars: int = 100
    fragment_width: float = 0.05
    sparse_lines: int = 12
    full_width: float = 0.55
    full_share: float = 0.25
    gutter: float = 0.03
    one_sided_share: float = 0.85
    side_balance: float = 0.30
    table_words: int = 3
    wide_gap: float = 20.0
    wide_gaps: int = 2
    table_lines: int = 3
    typical_gap: float = 12.0
    table_ratio: float = 0.15
    header_pages: int = 6
    header_ratio: float = 0.25
    header_least: int = 4
    header_band: float = 0.08
    header_chars: int = 8


@dataclass(frozen=True)
class ChunkLimits:
    """Packing and labelling of chunks."""

    target_words: int = 280
    overlap_words: int = 60
    least_words: int = 40
    share: float = 0.6
    hits: int = 2
    parent_share: float = 0.5
    parent_hits: int = 1
    actionable_signposted: int = 1
    actionable_plain: int = 3


@dataclass(frozen=True)
class RetrievalLimits:
    """Vector search."""

    default_k: int = 5
    most_k: int = 20
    dim: int = 64
    classes: tuple[str, ...] = CANONICAL_CLASSES


@dataclass(frozen=True)
class Settings:
    """All of them."""

    layout: LayoutLimits = field(default_factory=LayoutLimits)
    chunks: ChunkLimits = field(default_factory=ChunkLimits)
    retrieval: RetrievalLimits = field(default_factory=RetrievalLimits)


def settings_from(conf: Mapping[str, str], prefix: str = "granary.") -> Settings:
    """Settings with the values that ``conf`` (environment, or what ``spark.conf.getAll`` gives) has under names such as
    ``granary.retrieval.default_k``; lists are split at commas. An unknown name or a value of another type is an error."""
    out = Settings()
    for name, value in conf.items():
        if not name.startswith(prefix):
            continue
        group, _, key = name.removeprefix(prefix).partition(".")
        if group not in {f.name for f in fields(out)} or key not in {f.name for f in fields(getattr(out, group))}:
            raise ValueError(f"unknown setting {name}")
        held = getattr(out, group)
        kind = type(getattr(held, key))
        told = tuple(part.strip() for part in value.split(",") if part.strip()) if kind is tuple else kind(value)
        out = replace(out, **{group: replace(held, **{key: told})})
    return out
