"""DataFrame operators: retrieval, context planning, evaluation, throughput, stores, caches, workload, guards."""
