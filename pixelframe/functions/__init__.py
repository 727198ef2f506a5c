"""Column functions: file name keys, calibration, colors, times."""
