"""Synthetic training pairs and real two-epoch pairs."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import integer_below, uniform
from ..functions.masking import random_masks
from ..functions.naming import resolve_path
from ..functions.spectra import prepared_spectrum
from ..functions.vectors import ablate
from ..operators.joins import counted_side, pairs_with_files
from ..operators.neighbours import PartnerIndex, build_index, search, split_spread
from ..operators.ordering import with_group_positions
from ..operators.shape import class_target
from ..operators.split import class_weight, scaled_redshift, stratified_split
from ..session import freeze, handed_over
from ..settings import CONTINUUM_WINDOW, TAPER_LEN, master_grid
from .preprocessing import observed_wavelengths

PAIR_MODES = ("train", "val", "test")


def check_pair_parameters(mode, change_prob, class_sizes):
    if mode not in PAIR_MODES:
        raise ValueError(f"mode must be one of {PAIR_MODES}, got {mode}")
    if not 0.0 <= change_prob <= 1.0:
        raise ValueError(f"change_prob must be between 0 and 1, got {change_prob}")
    for agn_type in (1, 2):
        if not class_sizes.get(agn_type):
            raise ValueError(f"no spectra of type {agn_type}")


def draw_pairs(epoch_size, class_sizes, spark, seed=42, epoch=0, change_prob=0.15):
    """Targets, anchor class, anchor place within its class and partner class."""
    key = [F.col("pair_id"), F.lit(int(epoch))]
    n1, n2 = (F.lit(int(class_sizes[t])) for t in (1, 2))
    target = (uniform(key, seed, "target") < change_prob).cast("int")
    anchor = F.when(uniform(key, seed, "anchor class") < 0.5, 1).otherwise(2)
    drawn = spark.range(epoch_size).withColumnRenamed("id", "pair_id")
    drawn = drawn.withColumns({"label": target, "anchor_type": anchor})
    size = F.when(F.col("anchor_type") == 1, n1).otherwise(n2)
    place = F.least(F.floor(uniform(key, seed, "anchor") * size), size - 1).cast("bigint")
    same = F.col("label") == 0
    partner = F.when(same, F.col("anchor_type")).otherwise(3 - F.col("anchor_type"))
    return drawn.withColumns({"anchor_place": place, "partner_type": partner})


@dataclass(frozen=True)
class SplitIndex:
    """What all epochs of a split share: class sizes, places within the classes, partner index."""

    sizes: dict
    places: DataFrame
    partners: PartnerIndex


def index_split(spectra, k_neighbors=20):
    """Rank and index the spectra of a split once; hand the result to `sample_pairs` of every epoch."""
    slim = spectra.select("row_idx", "obj_id", "agn_type", "z", "snr")
    # two rows
    sizes = {r["agn_type"]: r["count"] for r in slim.filter("agn_type in (1, 2)").groupBy("agn_type").count().collect()}
    spread = split_spread(slim).first().asDict()
    places = freeze(with_group_positions(slim, "agn_type", "row_idx", name="place"))
    return SplitIndex(sizes, places, build_index(_candidates(slim), k_neighbors, spread))


def _candidates(spectra):
    return spectra.select(F.col("agn_type").alias("cls"), "z", "snr", F.col("obj_id").alias("obj"), "row_idx")


def matched_partners(anchors, spectra, k, spread=None, index=None):
    """Sorted partners (row_idx, dist) of each anchor row; raises where there is none.

    `anchors` has anchor_idx, z, snr, obj_id, partner_type; `spectra` the same naming with
    row_idx and agn_type, or an `index` over them. Equal anchors are searched once.
    """
    index = build_index(_candidates(spectra), k, spread) if index is None else index
    asked = anchors.select(
        F.col("partner_type").alias("q_class"),
        F.col("z").cast("double").alias("q_z"),
        F.col("snr").cast("double").alias("q_snr"),
        F.coalesce(F.col("obj_id").cast("string"), F.concat(F.lit("#"), F.col("anchor_idx"))).alias("q_obj"),
        *[c for c in anchors.columns if c not in ("z", "snr", "obj_id", "partner_type")],
    )
    found = search(index, asked, k)
    keys = ["q_class", "q_z", "q_snr", "q_obj"]
    lists = found.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", "row_idx", "dist"))).alias("partners")  # k entries
    )
    joined = asked.join(lists, keys, "left")
    none = F.raise_error(F.concat(F.lit("no partner for anchor "), F.col("anchor_idx").cast("string")))
    return joined.withColumn("partners", F.coalesce("partners", F.when(F.col("partners").isNull(), none)))


def sample_pairs(
    spectra, epoch_size=2000, k_neighbors=20, mode="train", change_prob=0.15, seed=42, epoch=0, index=None
):
    """Pair table: pair_id, label, first_idx, second_idx (row_idx of the spectra).

    In `train` mode the partner is one of the k nearest and the members may be swapped;
    otherwise it is the nearest. `spectra` should be a stored table: its narrow columns are
    read several times. `index` (from `index_split`) is built here if it is not given; several epochs
    share one. The pairs are frozen, so an epoch is drawn and searched once.
    """
    index = index_split(spectra, k_neighbors) if index is None else index
    check_pair_parameters(mode, change_prob, index.sizes)
    drawn = draw_pairs(epoch_size, index.sizes, spectra.sparkSession, seed, epoch, change_prob)
    anchors = drawn.join(
        index.places.withColumnsRenamed(
            {"agn_type": "anchor_type", "place": "anchor_place", "row_idx": "anchor_idx"}
        ),
        ["anchor_type", "anchor_place"],
    )
    k = k_neighbors if mode == "train" else 1
    matched = matched_partners(
        anchors.select("pair_id", "label", "anchor_idx", "z", "snr", "obj_id", "partner_type"), None, k, index=index.partners
    )
    key = [F.col("pair_id"), F.lit(int(epoch))]
    if mode == "train":
        choice = integer_below(uniform(key, seed, "neighbour"), F.size("partners"))
        swap = uniform(key, seed, "swap") > 0.5
    else:
        choice, swap = F.lit(0), F.lit(False)
    chosen = matched.withColumn("partner_idx", F.get("partners", choice)["row_idx"])
    first, second = F.col("anchor_idx"), F.col("partner_idx")
    pairs = chosen.select(
        "pair_id",
        "label",
        F.when(swap, second).otherwise(first).alias("first_idx"),
        F.when(swap, first).otherwise(second).alias("second_idx"),
    )
    return freeze(pairs)


def _member_flux(flux, keys, seed, grid, mask_lines, apply_masking):
    x = F.col(flux)
    if mask_lines:
        x = ablate(x, grid)
    return random_masks(x, keys, seed, grid) if apply_masking else x


def pair_vectors(pairs, spectra, grid=None, seed=42, mask_lines=False, apply_masking=False):
    """Fetch both members of each pair; each is ablated and masked on its own."""
    grid = master_grid() if grid is None else grid
    ids = pairs.select(F.explode(F.array("first_idx", "second_idx")).alias("row_idx")).distinct()
    # few pairs against a large catalogue: its vectors are filtered where they are read
    spectra = spectra.select("row_idx", "flux").join(counted_side(ids), "row_idx", "left_semi")
    out = pairs
    for side, number in (("first", 1), ("second", 2)):
        member = spectra.select(F.col("row_idx").alias(f"{side}_idx"), F.col("flux").alias(f"flux_{number}"))
        out = out.join(member, f"{side}_idx")
    for number in (1, 2):
        keys = [F.col("pair_id"), F.lit(number)]
        value = _member_flux(f"flux_{number}", keys, seed, grid, mask_lines, apply_masking)
        out = out.withColumn(f"flux_{number}", value)
    return out


def prepare_spectra(df, grid=None, seed=42, mask_lines=False, apply_masking=True, key="filename"):
    """Labelled single-spectrum set: target, scaled redshift, split, ablated or masked flux.

    Random masks touch the training rows only. Returns the table and the class weight of
    its training part.
    """
    grid = master_grid() if grid is None else grid
    labelled = scaled_redshift(df.filter(F.col("z").isNotNull()).withColumn("label", class_target()))
    parts = stratified_split(labelled, "label", key, seed)
    flux = ablate("flux", grid) if mask_lines else F.col("flux")
    if apply_masking:
        flux = F.when(F.col("split") == "train", random_masks(flux, [key], seed, grid)).otherwise(flux)
    return parts.withColumn("flux", flux), class_weight(parts, where=F.col("split") == "train")


def resolve_pairs(manifest, first_dir, second_dir):
    return manifest.withColumns(
        {
            "dr16_path": resolve_path(first_dir, "specname_dr16"),
            "sdssv_path": resolve_path(second_dir, "specname_sdssv"),
        }
    )


def _member_key(path, z):
    """One text for a spectrum at a redshift, missing ones included."""
    return F.concat(F.coalesce(F.col(z).cast("string"), F.lit("?")), F.lit(" "), F.col(path))


def preprocess_pairs(
    manifest, spectra, listing=None, grid=None, window=CONTINUUM_WINDOW, taper_len=TAPER_LEN, keep_raw=False
):
    """Real pairs with processed vectors, and the log of skipped pairs.

    `manifest` has dr16_path and sdssv_path (see `resolve_pairs`), `spectra` one raw
    spectrum per `path`. A spectrum used by several pairs at one redshift is processed
    once: the distinct (path, z) keys meet the spectra before the kernel runs.
    """
    grid = master_grid() if grid is None else grid
    listing = spectra.select("path") if listing is None else listing
    kept, missing = pairs_with_files(manifest, listing)
    sides = {1: "dr16_path", 2: "sdssv_path"}
    members = kept.select("z", F.explode(F.array(*sides.values())).alias("path"))
    # frozen before it is counted: behind it stand the existence joins
    wanted = spectra.drop("z").join(counted_side(freeze(members.select("path", "z").distinct())), "path")
    done = wanted.select(
        _member_key("path", "z").alias("member"),
        prepared_spectrum(
            observed_wavelengths(wanted),
            F.col("flux"),
            F.col("z"),
            grid,
            window,
            taper_len,
            sanitize=True,
            keep_raw=keep_raw,
        ).alias("p"),
    )
    # pairs and log both read it: the kernel runs once; each pair gets its members from it by their key
    done = handed_over(done, "members", by=("member",))
    named = kept
    for side, path in sides.items():
        named = named.withColumn(f"__member_{side}", _member_key(path, "z"))
    for side in sides:
        processed = done.select(F.col("member").alias(f"__member_{side}"), F.col("p").alias(f"p{side}"))
        named = named.join(processed, f"__member_{side}", "left")
    error = F.coalesce(F.col("p1.error"), F.col("p2.error"))
    raw = ["raw"] if keep_raw else []
    good = named.filter(error.isNull()).select(
        *kept.columns, *[F.col(f"p{s}.{f}").alias(f"{f}_{s}") for s in (1, 2) for f in ["flux"] + raw]
    )
    failed = named.filter(error.isNotNull()).select(
        *kept.columns, F.lit("preprocessing_failed").alias("skip_reason"), error.alias("error")
    )
    return good, missing.unionByName(failed, allowMissingColumns=True)
