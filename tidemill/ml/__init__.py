"""Model fitting, nearest neighbours, Gram-based search and the registries."""
