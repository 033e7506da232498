"""Parameters of the linkage pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field

EXACT, SORTED, FIRST2, ADDRESS, RARE = "exact_name", "sorted_name", "first2_tokens", "address_key", "rare_token"
CHANNELS = (EXACT, SORTED, FIRST2, ADDRESS, RARE)


@dataclass(frozen=True)
class LinkageConfig:
    """``caps``: candidates a channel may take per source and key (in row order); ``df_ceiling``: largest document
    frequency of a rare token; ``negatives``: kept per S1 record; ``split_modulus``: one part in so many is validation."""

    caps: dict[str, int] = field(default_factory=lambda: {EXACT: 100, SORTED: 100, FIRST2: 50, ADDRESS: 50, RARE: 50})
    df_ceiling: int = 5000
    negatives: int = 3
    split_modulus: int = 5
    model_rows: int = 200_000
    seed: int = 42

    def __post_init__(self) -> None:
        missing = set(CHANNELS) - set(self.caps)
        if missing:
            raise ValueError(f"caps lack {sorted(missing)}")


#: Caps used when each channel is evaluated alone.
SINGLE_CAPS = {EXACT: 500, SORTED: 500, FIRST2: 300, ADDRESS: 300, RARE: 200}
