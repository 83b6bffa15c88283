"""Parameters of an analysis: defaults, then the user's values by name."""

from __future__ import annotations

import json
import runpy
from dataclasses import asdict, dataclass, field, fields


@dataclass(frozen=True)
class Params:
    """Every key of the parameter surface with its default."""

    verbose: bool = False
    debug: bool = False
    nthreads: int = 4
    handle: str = "default"
    output_folder: str = ""
    omega_m: float = 0.31
    do_recon: bool = True
    nbins: int = 512
    padding: float = 200.0
    smooth: float = 10.0
    bias: float = 2.0
    f: float = 0.78
    niter: int = 3
    tracer_file: str = ""
    tracer_file_type: int = 1
    tracer_posn_cols: list[int] = field(default_factory=lambda: [0, 1, 2])
    is_box: bool = False
    box_length: float = 1500.0
    z_low_cut: float = 0.4
    z_high_cut: float = 0.73
    weights_model: int = 1
    fkp: bool = False
    cp: bool = False
    noz: bool = False
    systot: bool = False
    veto: bool = False
    comp: bool = False
    random_file: str = ""
    random_file_type: int = 1
    random_posn_cols: list[int] = field(default_factory=lambda: [0, 1, 2])
    run_voxelvoids: bool = True
    run_tessellation_voids: bool = True
    z_min: float = 0.43
    z_max: float = 0.70
    void_prefix: str = "Voids"
    min_dens_cut: float = 1.0
    use_barycentres: bool = True
    find_clusters: bool = False
    cluster_prefix: str = "Clusters"
    max_dens_cut: float = 1.0
    do_tessellation: bool = True
    guard_nums: int = 30
    use_mpi: bool = False
    box_div: int = 2
    box_buffer: float = 0.08
    mask_file: str = ""
    use_z_wts: bool = True
    use_syst_wts: bool = True
    use_completeness_wts: bool = True
    mock_file: str = ""
    mock_dens_ratio: float = 10.0
    void_min_num: int = 5
    cluster_min_num: int = 5

    def clamped(self) -> Params:
        """Redshift limits no wider than the cuts, for the tessellation."""
        return Params(**asdict(self) | {"z_min": max(self.z_min, self.z_low_cut), "z_max": min(self.z_max, self.z_high_cut)})


def from_dict(values: dict) -> Params:
    """Known names override the defaults; others are an error."""
    known = {f.name for f in fields(Params)}
    odd = sorted(set(values) - known)
    if odd:
        raise ValueError(f"unknown parameters: {', '.join(odd)}")
    return Params(**values)


def from_file(path: str) -> Params:
    """Defaults overridden by the names that a Python file of assignments defines."""
    known = {f.name for f in fields(Params)}
    return Params(**{k: v for k, v in runpy.run_path(path).items() if k in known})


def save_state(path: str, state: dict) -> None:
    """What a later run needs to go on without tessellating again."""
    with open(path, "w") as f:
        json.dump(state, f, indent=1, sort_keys=True)


def load_state(path: str) -> dict:
    with open(path) as f:
        return json.load(f)
