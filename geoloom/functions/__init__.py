"""Column functions: geometry, network weights and recodes."""
