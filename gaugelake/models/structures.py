"""Chemical structures by RDKit, where it is installed; each function takes the library's modules, so that a stand-in will do."""

from __future__ import annotations

from collections.abc import Callable


def library():
    """RDKit's modules; an error that says what is missing where it is not installed."""
    try:
        from rdkit import Chem
        from rdkit.Chem import Descriptors, MACCSkeys, rdFingerprintGenerator
        from rdkit.Chem.MolStandardize import rdMolStandardize
        from rdkit.Chem.Scaffolds import MurckoScaffold
    except ModuleNotFoundError as missing:
        raise RuntimeError("structures need RDKit, which is not installed here") from missing
    return {"chem": Chem, "descriptors": Descriptors, "keys": MACCSkeys, "fingerprints": rdFingerprintGenerator, "standardize": rdMolStandardize, "scaffolds": MurckoScaffold}


def key_or_none(chem, molecule) -> str | None:
    """The structure's key, null where the library can't make one."""
    try:
        return chem.MolToInchiKey(molecule) or None
    except Exception:  # noqa: BLE001  a key is optional
        return None


def parse(text: str, tools: dict | None = None) -> dict:
    """The record of a structure (see ``adapters.standardize``): canonical text, fragment parent and its key, scaffold, charge, heavy atoms and weight. ValueError: no structure."""
    tools = tools or library()
    chem = tools["chem"]
    molecule = chem.MolFromSmiles(text)
    if molecule is None:
        raise ValueError(f"no structure: {text}")
    parent = tools["standardize"].FragmentParent(molecule)
    return {
        "canonical": chem.MolToSmiles(molecule), "parent": chem.MolToSmiles(parent), "parent_key": key_or_none(chem, parent), "group_text": tools["scaffolds"].MurckoScaffoldSmiles(mol=parent),
        "charge": int(chem.GetFormalCharge(parent)), "heavy_atoms": int(parent.GetNumHeavyAtoms()), "weight": float(tools["descriptors"].MolWt(parent)),
    }


def bits_of(vector) -> list[int]:
    """Places of the set bits of a bit vector."""
    return [int(b) for b in vector.GetOnBits()]


def features(radius: int = 2, n_bits: int = 2048, chirality: bool = True, kind: str = "morgan", tools: dict | None = None) -> Callable:
    """A function of a structure's text that gives (all descriptors in the library's order, set bits of its fingerprint, failures); kind: morgan or maccs."""

    def compute(text: str) -> tuple[list, list[int], list[tuple[str, str]]]:
        own = tools or library()
        molecule = own["chem"].MolFromSmiles(text)
        if molecule is None:
            raise ValueError(f"no structure: {text}")
        values, failures = [], []
        for name, function in own["descriptors"]._descList:
            try:
                values.append(float(function(molecule)))
            except Exception as e:  # noqa: BLE001  one descriptor does not end the others
                values.append(None)
                failures.append((name, str(e)[:200]))
        if kind == "maccs":
            return values, bits_of(own["keys"].GenMACCSKeys(molecule)), failures
        made = own["fingerprints"].GetMorganGenerator(radius=radius, fpSize=n_bits, includeChirality=chirality)
        return values, bits_of(made.GetFingerprint(molecule)), failures

    return compute


def aromatic_proportion(text: str, tools: dict | None = None) -> float:
    """Aromatic atoms over heavy atoms; 0 for a structure without any."""
    chem = (tools or library())["chem"]
    molecule = chem.MolFromSmiles(text)
    if molecule is None:
        raise ValueError(f"no structure: {text}")
    heavy = molecule.GetNumHeavyAtoms()
    return sum(bool(a.GetIsAromatic()) for a in molecule.GetAtoms()) / heavy if heavy else 0.0
