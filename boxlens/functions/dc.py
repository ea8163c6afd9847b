"""Distribution-centre vocabularies and the code -> name normalisation."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES - these must equal the analysed reports exactly.
# ---------------------------------------------------------------------------

# Raw dc codes accepted on the error table (note: 'BV ' with a blank is not).
ERROR_DC_CODES = (
    "NZ", "GR", "Barleben", "BL", "SK", "Dublin", "CH", "LI", "FR", "Madrid",
    "Melbourne", "Milan", "BV", "MO", "NO", "Perth", "Sydney", "VE",
)

# Canonical dc names accepted on the box table.
BOX_DCS = (
    "Auckland", "Banbury", "Barleben", "Bjuv", "Dublin", "Koelliken", "Lisses",
    "Madrid", "Melbourne", "Milan", "Nuneaton", "Oslo", "Perth", "Prismalaan",
    "Sydney", "Verden",
)

# Vocabulary A: canonical name -> raw codes (22 names).
VOCAB_A = {
    "Auckland": ("NZ", "NZL", "Chilli Bin", "nz"),
    "Banbury": ("GR", "gr"),
    "Barleben": ("Barleben", "bx", "BRN", "BX"),
    "Bleiswijk": ("BL", "NL", "NL KP", "sh"),
    "Cloudberry": ("SE", "SK", "SW", "Bjuv"),
    "Co-Packer": ("WF",),
    "Derby": ("TO",),
    "Edmonton": ("AB", "CAN AB"),
    "Japan": ("JP",),
    "Koelliken": ("CH",),
    "Lisses": ("FR", "LI", "Lisses", "li", "Lisse"),
    "Madrid": ("Madrid",),
    "Melbourne": ("ML", "AUS MEL", "ml"),
    "Milan": ("IT",),
    "Nuneaton": ("BV", "BV ", "bv"),
    "Ontario": ("ON", "On", "CAN ON (T+S)", "Toronto"),
    "Oslo": ("MO", "NO"),
    "Perth": ("PH", "AUS PER", "Casa", "ph"),
    "Sydney": ("SY", "AUS SYD", "Esky", "sy"),
    "Vancouver": ("BC", "CAN BC"),
    "Verden": ("AT", "DE", "VE", "ve"),
    "unassigned": ("unmapped",),
}

# Vocabulary B: canonical name -> raw codes (15 names). These names match the
# box table, so any errors <-> boxes join on dc uses this vocabulary.
VOCAB_B = {
    "Auckland": ("NZ", "NZL", "Chilli Bin", "nz"),
    "Banbury": ("GR", "gr"),
    "Barleben": ("Barleben", "bx", "BRN", "BX"),
    "Prismalaan": ("BL", "NL", "NL KP", "sh"),
    "Bjuv": ("SE", "SK", "SW", "Bjuv"),
    "Koelliken": ("CH",),
    "Lisses": ("FR", "LI", "Lisses", "li", "Lisse"),
    "Madrid": ("Madrid",),
    "Melbourne": ("ML", "AUS MEL", "ml"),
    "Milan": ("IT",),
    "Nuneaton": ("BV", "BV ", "bv"),
    "Oslo": ("MO", "NO"),
    "Perth": ("PH", "AUS PER", "Casa", "ph"),
    "Sydney": ("SY", "AUS SYD", "Esky", "sy"),
    "Verden": ("AT", "DE", "VE", "ve"),
}

VOCABULARIES = {"a": VOCAB_A, "b": VOCAB_B}


def code_to_name(vocabulary: str) -> dict[str, str]:
    """Flatten a vocabulary into ``{raw code: canonical name}``."""
    vocab = VOCABULARIES[vocabulary]
    return {code: name for name, codes in vocab.items() for code in codes}


def normalise_dc(code: Column | str, vocabulary: str = "b") -> Column:
    """Raw dc code -> canonical name; unknown codes pass through.

    The vocabulary is a literal map evaluated per row inside codegen: no join,
    no shuffle and no broadcast, whatever the size of the input.
    """
    code = F.col(code) if isinstance(code, str) else code
    mapping = code_to_name(vocabulary)
    lookup = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    return F.coalesce(F.try_element_at(lookup, code), code)


def sql_case(code_col: str, vocabulary: str = "b") -> str:
    """The same mapping as a SQL CASE expression (for SQL texts)."""
    mapping = code_to_name(vocabulary)
    arms = " ".join(
        f"WHEN {code_col} = '{k}' THEN '{v}'" for k, v in mapping.items()
    )
    return f"CASE {arms} ELSE {code_col} END"


# FIXED VALUES: short market labels (dormant variant D02); others pass through.
MARKET_LABELS = {"BENELUX": "BNL", "Nordics": "NORDICS", "Ireland": "IE", "Spain": "ES"}


def market_label(market: Column | str) -> Column:
    """Country group -> short market label, unknown groups pass through."""
    market = F.col(market) if isinstance(market, str) else market
    lookup = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in MARKET_LABELS.items()))
    return F.coalesce(F.try_element_at(lookup, market), market)
