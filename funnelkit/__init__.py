"""funnelkit: funnel and conversion analytics as Spark DataFrame jobs.

Reports live in `funnelkit.plans` (catalogue: `funnelkit.reports.REPORTS`),
shared building blocks in `funnelkit.operators` and `funnelkit.functions`,
inputs and outputs in `funnelkit.sources`, the streaming job in
`funnelkit.streaming`. `python -m funnelkit --help` for the command line.
"""

__version__ = "0.1.0"
