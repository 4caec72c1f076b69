"""Fixed values of baseline image coding, and tables that follow from a rule."""

from __future__ import annotations

import math

import numpy as np

# Quantization of luma and of chroma, row by row (JPEG standard, Annex K).
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
)
# Weights of red, green and blue in luma, first and second chroma; and the level shift of each.
COLOUR = ((0.299, 0.587, 0.114), (-0.1687, -0.3312, 0.5), (0.5, -0.4186, -0.0813))
SHIFT = (-128.0, 0.0, 0.0)
# Longest code that the depth limit leaves.
LONGEST = 15

#: Row-major position of each zig-zag place: diagonals by i + j, odd ones downwards, even ones upwards.
ZIGZAG = tuple(8 * i + j for i, j in sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1])))


def cosine_basis() -> np.ndarray:
    """The orthonormal 8-point cosine basis: row k is frequency k."""
    return np.array([[math.sqrt((1 if k else 0.5) / 4) * math.cos((2 * n + 1) * k * math.pi / 16) for n in range(8)] for k in range(8)])


#: For whole blocks in row-major order: block @ BLOCK_BASIS.T gives the coefficients.
BLOCK_BASIS = np.kron(cosine_basis(), cosine_basis())
