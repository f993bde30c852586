"""Parameter objects. Defaults are the shipped configuration template's values."""

from __future__ import annotations

from dataclasses import dataclass, fields


# Names and defaults of the configuration keys.
@dataclass(frozen=True)
class ProfileParams:
    rare_threshold: int = 3
    rare_limit: int = 2000
    min_probability: float = 0.30
    min_pair_count: int = 5
    timeline_bins: int = 60
    top_countries: int = 15
    chart_countries: int = 10


@dataclass(frozen=True)
class FeatureParams:
    """One toggle per feature block, plus the unit of the duration inputs.

    `duration_units="seconds"` compares like with like. `"legacy"` feeds raw
    microseconds into a profile kept in seconds, as the original pipeline does.
    """

    use_raw_duration: bool = True
    use_raw_src_bytes: bool = True
    use_raw_dst_bytes: bool = True
    use_raw_src_packets: bool = True
    use_raw_dst_packets: bool = True
    use_robust_duration: bool = True
    use_robust_src_bytes: bool = True
    use_robust_dst_bytes: bool = True
    use_rare_src_ip: bool = True
    use_protocol_encoding: bool = True
    duration_units: str = "seconds"

    def __post_init__(self):
        if self.duration_units not in ("seconds", "legacy"):
            raise ValueError(f"duration_units: {self.duration_units!r}")

    @classmethod
    def from_config(cls, flags: dict, duration_units: str = "seconds") -> FeatureParams:
        """Toggles missing from a configuration are off."""
        toggles = {f.name: bool(flags.get(f.name, False))
                   for f in fields(cls) if f.name.startswith("use_")}
        return cls(**toggles, duration_units=duration_units)

    @classmethod
    def only(cls, *names: str, duration_units: str = "seconds") -> FeatureParams:
        return cls.from_config(dict.fromkeys(names, True), duration_units)


@dataclass(frozen=True)
class TrainParams:
    """`sync="average"` trains one model, averaging the shards' weights after
    every epoch; `sync="none"` keeps one independent model per shard. A result depends on
    the number of shards, each of which one task trains. It does not follow from the files: it is
    `shards` or, where that is None, one for every `rows_per_shard` rows and 8 at least."""

    model_type: str = "autoencoder"
    hidden_dims: tuple[int, ...] = (32, 16)
    latent_dim: int = 8
    batch_size: int = 256
    epochs: int = 5
    learning_rate: float = 0.001
    sync: str = "average"
    shards: int | None = None
    rows_per_shard: int = 2_000_000
    seed: int = 0

    def __post_init__(self):
        if self.sync not in ("average", "none"):
            raise ValueError(f"sync: {self.sync!r}")
        if self.shards is not None and self.shards < 1:
            raise ValueError(f"shards: {self.shards!r}")

    def shards_for(self, rows: int) -> int:
        return self.shards or max(8, -(-rows // self.rows_per_shard))

    @classmethod
    def from_config(cls, nn: dict, **overrides) -> TrainParams:
        """Reads an `nn` configuration block; its gaps take the code fallbacks."""
        ae = nn.get("autoencoder", {})
        return cls(
            model_type=nn.get("model_type", "autoencoder"),
            hidden_dims=tuple(ae.get("encoder_hidden_dims", (16, 8))),
            latent_dim=ae.get("latent_dim", 4),
            batch_size=nn["batch_size"],
            epochs=nn.get("epochs", 5),
            learning_rate=nn.get("learning_rate", 0.001),
            **overrides,
        )
