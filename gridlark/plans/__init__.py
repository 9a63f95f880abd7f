"""Cubes: the query's description, its plan, and values shown relative to each other."""

from gridlark.plans.cube import AxisDimension, AxisSort, Cube, CubeAxis, CubeSpec, Expansion

__all__ = ["AxisDimension", "AxisSort", "Cube", "CubeAxis", "CubeSpec", "Expansion"]
