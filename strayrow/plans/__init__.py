"""Several detectors fitted and applied together."""
