"""Operators for training data: similarity clusters, neighbour lists, varied subsets, packing, leakage and residue."""
