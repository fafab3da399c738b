"""How the work is laid out on the cluster, and the stages built from operators."""
