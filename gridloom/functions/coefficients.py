"""Coefficients of the convection-diffusion-reaction problems, as SQL expressions of x, y, z."""

from __future__ import annotations

# Fixed values of the four coefficient sets: diffusion a, convection b, reaction c (EPS is the set's parameter).
SETS_3D = {
    "const": {"eps": 1 / 80, "a": "EPS", "b": ("0D", "0D", "0D"), "c": "0D"},
    "exp": {"eps": 1 / 160, "a": "EPS*exp(-(x+y+z))", "b": ("0D", "0D", "0D"), "c": "0D"},
    "box": {"eps": 1 / 80, "a": "EPS", "b": ("1D/sqrt(3D)",) * 3, "c": "0D"},
    "gauss": {"eps": 1 / 80, "a": "EPS*exp(-(x*x+y*y+z*z))", "b": tuple(f"(1D/sqrt(3D)-2D*{k}*exp(-(x*x+y*y+z*z)))" for k in "xyz"), "c": "0D"},
}
SETS_2D = {
    "const": {"eps": 1 / 80, "a": "EPS", "b": ("0D", "0D"), "c": "0D"},
    "exp": {"eps": 1 / 80, "a": "EPS*exp(-(x+y))", "b": ("0D", "0D"), "c": "0D"},
    "box": {"eps": 1 / 80, "a": "EPS", "b": ("1D/1.414D",) * 2, "c": "0D"},
    "gauss": {"eps": 1 / 80, "a": "EPS*exp(-(x*x+y*y))", "b": tuple(f"(1D/sqrt(3D)-2D*{k}*exp(-(x*x+y*y)))" for k in "xy"), "c": "0D"},
}


def boundary(x: str) -> str:
    """Dirichlet data: 1 on the faces x = 0 and x = 1, else 0."""
    return f"(CASE WHEN {x} = 0D OR {x} = 1D THEN 1D ELSE 0D END)"
