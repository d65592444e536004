"""Media containers and bitstream headers as tables."""
