from .expressions import (
    as_int_floor,
    binary_entropy,
    harmonic,
    literal_array,
    order_key,
    uniform,
    yeo_johnson,
    z_bin,
)

__all__ = [
    "as_int_floor",
    "binary_entropy",
    "harmonic",
    "literal_array",
    "order_key",
    "uniform",
    "yeo_johnson",
    "z_bin",
]
