"""Column functions: bytes, packet headers, flow keys, features, inter-arrival codes."""
