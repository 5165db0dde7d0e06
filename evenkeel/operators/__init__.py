"""The stages: time series, poll, normalise, index, pack, compare, elect, observe."""
