"""Column-level functions: tokenizers, scoring kernels, codecs."""
