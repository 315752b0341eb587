"""Operators on voxel, region, detection, track, feature and behaviour tables."""
