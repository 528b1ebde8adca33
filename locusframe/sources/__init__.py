"""Readers and writers of genome file formats, as DataFrames.

Readers split files by record where the format allows it, so that large files are shared by many
tasks, and have fixed schemas.
"""

from .bam import read_bam, write_bam
from .readers import (
    read_bedgraph,
    read_config,
    read_fasta,
    read_genbank,
    read_genepred,
    read_gff,
    read_gtf,
    read_maf,
    read_newick,
    read_profile,
    read_psl,
    read_sam,
    read_sections,
    read_wiggle,
)
from .writers import write_bed12, write_bedgraph, write_fasta, write_genbank, write_genepred, write_gff, write_gtf, write_loci, write_wiggle

__all__ = [
    "read_bam", "read_bedgraph", "read_config", "read_fasta", "read_genbank", "read_genepred", "read_gff", "read_gtf", "read_maf", "read_newick", "read_profile", "read_psl", "read_sam", "read_sections", "read_wiggle",
    "write_bam", "write_bed12", "write_bedgraph", "write_fasta", "write_genbank", "write_genepred", "write_gff", "write_gtf", "write_loci", "write_wiggle",
]
