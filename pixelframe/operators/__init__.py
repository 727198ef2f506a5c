"""Frame, pixel, region and series operators: each a DataFrame to DataFrame transform."""
