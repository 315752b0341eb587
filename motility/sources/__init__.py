"""File manifests, names, calibration and the final cell table."""
